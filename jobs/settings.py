"""Command lines and config files of the jobs."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable
from pathlib import Path

from quarry.session import build_session


def settings(defaults: dict, given: dict) -> dict:
    """``defaults`` with what is given; names that no job knows are an error."""
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings {unknown}; known are {sorted(defaults)}")
    return defaults | given


def command(name: str, paths: dict[str, str], config: Path, run: Callable) -> Callable:
    """A main() that reads the arguments and the config file, and starts and stops the session.

    paths: argument to its help text, in the order that run(spark, *paths, settings) takes them.
    """

    def main(argv: list[str] | None = None) -> int:
        parser = argparse.ArgumentParser(name)
        for argument, text in paths.items():
            parser.add_argument(f"--{argument}", required=True, help=text)
        parser.add_argument("--config", default=str(config), help="settings as TOML")
        args = parser.parse_args(argv)
        logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
        logging.getLogger("py4j").setLevel(logging.WARNING)
        given = tomllib.loads(Path(args.config).read_text())
        spark = build_session(name)
        try:
            run(spark, *(getattr(args, p) for p in paths), given)
        finally:
            spark.stop()
        return 0

    return main
