"""Config files of jobs: a JSON object of settings, read through Spark so that it may lie anywhere."""

from __future__ import annotations

import json
import logging
from argparse import ArgumentParser, Namespace

from pyspark.sql import SparkSession


def arguments(description: str, *paths: str) -> Namespace:
    """Command line: ``--config`` and the given paths, all required."""
    parser = ArgumentParser(description=description)
    for name in ("config", *paths):
        parser.add_argument(f"--{name}", required=True)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return parser.parse_args()


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """``defaults`` with the file's settings; a name that is not among them, or another type, is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    for name, value in given.items():
        if name not in defaults:
            raise ValueError(f"{path}: no setting is called {name}")
        if not isinstance(value, type(defaults[name])):
            raise ValueError(f"{path}: {name} is not of type {type(defaults[name]).__name__}")
    return defaults | given
