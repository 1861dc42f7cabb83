"""quarry: corpus building, batched retrieval and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
