"""What the jobs' command lines share: arguments, the config file, logging and the session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


def configured(path: str | None, defaults: dict[str, Any]) -> dict[str, Any]:
    """defaults with what the JSON file at path has instead; other names than those of defaults are an error."""
    given = json.loads(open(path).read()) if path else {}
    unknown = sorted(given.keys() - defaults.keys())
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def main(name: str, doc: str, defaults: dict[str, Any], run: Callable[[SparkSession, str, str, dict[str, Any]], dict[str, int]]) -> None:
    """Reads the arguments, runs the job in a session of its own and stops that."""
    parser = argparse.ArgumentParser(prog=name, description=doc)
    parser.add_argument("input", help="folder or address of the tables")
    parser.add_argument("output", help="folder or address of what the job writes and keeps")
    parser.add_argument("--config", help="JSON file of settings")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.input.rstrip("/"), args.output.rstrip("/"), configured(args.config, defaults))
    finally:
        spark.stop()
