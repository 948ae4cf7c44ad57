"""Fetching a frontier over HTTP, in Arrow batches; optional, for where there is a network.

Certificates are checked. Rows of one host share a partition, and each waits
the delay before its request, so a host sees one request at a time from a task.
"""

from __future__ import annotations

import json
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import urls as U
from .pages import api_url

ACCEPT = "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"
ACCEPT_API = "application/json"


def get(url: str, config: Config, accept: str = ACCEPT) -> tuple[int | None, str | None, str | None]:
    """(status, text, error) of a GET that follows redirects."""
    request = urllib.request.Request(url, headers={"User-Agent": config.user_agent, "Accept": accept})
    try:
        with urllib.request.urlopen(request, timeout=config.request_timeout, context=ssl.create_default_context()) as answer:
            charset = answer.headers.get_content_charset() or "utf-8"
            return answer.status, answer.read().decode(charset, "replace"), None
    except urllib.error.HTTPError as e:
        return e.code, None, None
    except (OSError, ValueError, LookupError) as e:
        return None, None, f"{type(e).__name__}: {e}"[:200]


def _has_body(raw: str | None) -> bool:
    try:
        return bool(json.loads(raw or "")["body"]["view"]["value"])
    except (ValueError, KeyError, TypeError):
        return False


def fetch(frontier: DataFrame, config: Config = Config(), fetch_one: Callable[..., tuple] = get) -> DataFrame:
    """frontier (url) with status, html, error and api, the REST answer.

    With config.api_base, an address with a page id is asked there first; HTML is fetched where that gives no body.
    """

    def one(url: str, asked: str | None) -> tuple:
        if asked is not None:
            status, raw, _ = fetch_one(asked, config, ACCEPT_API)
            if status == 200 and _has_body(raw):
                return status, None, None, raw
        return *fetch_one(url, config), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for url, asked in zip(frame["url"], frame["_asked"]):
                time.sleep(config.delay_seconds)
                found.append(one(url, asked))
            yield frame.drop(columns="_asked").assign(**{n: [x[i] for x in found] for i, n in enumerate(("status", "html", "error", "api"))})

    schema = ", ".join(f"`{n}` {t}" for n, t in frontier.dtypes) + ", status int, html string, error string, api string"
    asked = api_url(config.api_base, U.page_id(F.col("url"))) if config.api_base else F.lit(None).cast("string")
    return frontier.withColumn("_asked", asked).repartition(config.max_workers, U.host(F.col("url"))).mapInPandas(run, schema)
