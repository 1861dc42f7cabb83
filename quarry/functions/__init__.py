"""Column functions: text, rankings, dates, chunking folds and markup rendering."""
