"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from dataclasses import fields
from typing import Any

from pyspark.sql import SparkSession


def settings(kind: type, path: str | None, default: str) -> Any:
    """A dataclass of settings from a JSON file; unknown names are an error."""
    with open(path or os.path.join(os.path.dirname(os.path.abspath(__file__)), default), encoding="utf-8") as f:
        given = json.load(f)
    if extra := set(given) - {x.name for x in fields(kind)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def command_line(about: str, paths: dict[str, str], argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=about)
    p.add_argument("--config", help="settings as JSON; those beside the job by default")
    for name, told in paths.items():
        p.add_argument(f"--{name}", required=True, help=told)
    return p.parse_args(argv)


def started(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
