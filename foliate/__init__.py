"""Turns documentation and web pages into a retrieval-ready corpus, on Spark."""

import os

from .config import Config

__all__ = ["Config", "on_workers"]

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _with_root(paths: str | None) -> str:
    have = [p for p in (paths or "").split(os.pathsep) if p]
    return os.pathsep.join(have if _ROOT in have else [_ROOT, *have])


def on_workers(context) -> None:
    """Lets Python workers that see this folder import the package. Elsewhere ship it with --py-files."""
    context.environment["PYTHONPATH"] = _with_root(context.environment.get("PYTHONPATH"))


def _announce() -> None:
    from pyspark import SparkContext

    os.environ["PYTHONPATH"] = _with_root(os.environ.get("PYTHONPATH"))  # for a JVM that is still to start
    if SparkContext._active_spark_context is not None:
        on_workers(SparkContext._active_spark_context)


_announce()
