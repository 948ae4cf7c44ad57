"""Page stores: tables of fetched pages, and the REST form of a page as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..functions import urls as U
from ..operators import html as H

API_SCHEMA = "struct<title:string,body:struct<view:struct<value:string>>,children:struct<page:struct<results:array<struct<id:string>>>>>"
#: Fixed value: what a REST request asks for.
API_EXPAND = "body.view,children.page,title"

#: HTTP statuses of pages that are no longer there.
GONE = (404, 410)


def api_url(base: str, page_id: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), page_id, F.lit(f"?expand={API_EXPAND}"))


def api_page(raw: Column) -> Column:
    """Struct of title, html and child_ids of a REST answer; null if it is no JSON or has no body."""
    doc = F.from_json(raw, API_SCHEMA)
    value = F.coalesce(doc["body"]["view"]["value"], F.lit(""))
    ids = F.transform(F.coalesce(doc["children"]["page"]["results"], F.array().cast("array<struct<id:string>>")), lambda r: r["id"])
    ids = F.filter(ids, lambda i: i.isNotNull() & ~i.isin("", "0", "false"))
    return F.when(value != "", F.struct(F.coalesce(doc["title"], F.lit("")).alias("title"), value.alias("html"), ids.alias("child_ids")))


def store(pages: DataFrame, config: Config = Config(), allowed: Sequence[str] = (), preferred: str | None = None) -> DataFrame:
    """url, title, markdown, children, error, http_status and met (true) of raw pages.

    pages: url, html, and optionally status (HTTP), error (of a fetch) and api (REST answer), which is tried first.
    Statuses other than 200 have no content, and are an error but for those that say that a page is gone. Of several
    rows with one canonical url the first by raw url counts; of those with the same raw url the one of least page_id,
    where pages have one, and without it the first by a hash of what was fetched, so that runs agree.
    """
    raw = pages.withColumn("_raw", F.col("url")).withColumn("url", U.canonical(F.col("url"), allowed, preferred))
    if "status" in pages.columns:
        raw = raw.withColumn("html", F.when(F.col("status") == 200, F.col("html")))
    given = lambda name, kind: F.col(name).cast(kind) if name in pages.columns else F.lit(None).cast(kind)
    answer = api_page(F.col("api")) if "api" in pages.columns else F.lit(None).cast("struct<title:string,html:string,child_ids:array<string>>")
    fetched = [F.col("html").cast("string").alias("html"), answer.alias("api"), given("status", "int").alias("status"), given("error", "string").alias("error")]
    first = F.when(F.col("_raw").isNotNull(), F.struct("_raw", given("page_id", "bigint").alias("i"), F.xxhash64(*fetched).alias("h")))
    raw = raw.groupBy("url").agg(F.min_by(F.struct(*fetched, "_raw"), first).alias("p"))
    # the struct is taken once: the UDF runs once a page
    rows = raw.select("url", "p", H.extract(F.coalesce("p.api.html", "p.html")).alias("x"))
    ids = F.transform("p.api.child_ids", lambda i: F.concat(F.lit(f"https://{preferred or ''}/pages/viewpage.action?pageId="), i))
    title = F.when(F.col("p.api").isNotNull(), F.col("p.api.title")).otherwise(T.title_without_site(F.col("x.title"), config.site_names))
    refused = F.when(~F.col("p.status").isin(200, *GONE), F.concat(F.lit("HTTP "), F.col("p.status").cast("string")))
    rows = rows.select(
        "url", title.alias("title"), T.clean_noise(F.col("x.markdown")).alias("markdown"),
        F.when(F.col("p.api").isNotNull(), ids).otherwise(F.col("x.hrefs")).alias("hrefs"), F.coalesce("p.error", refused, "x.error").alias("error"),
        F.col("p.status").alias("http_status"), F.lit(True).alias("met"),
    )
    links = rows.select("url", F.posexplode("hrefs").alias("position", "href"))
    links = links.select("url", "position", U.canonical(U.join(F.col("url"), F.col("href")), allowed, preferred).alias("child")).where("child is not null")
    children = links.groupBy("url", "child").agg(F.min("position").alias("position")).groupBy("url")
    children = children.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "child"))), lambda x: x["child"]).alias("children"))
    return rows.drop("hrefs").join(children, "url", "left")


def gone(found: DataFrame, known: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Addresses (url) of known pages that surely are no longer there: found with a status that says so, or, where there is
    a store (kept: url), absent from it. A page that no link leads to, that failed, or that is empty is not gone; and none
    is while a root could not be read, unless the root itself is gone."""
    if found.where((F.col("depth") == 1) & ~F.coalesce(F.col("http_status").isin(*GONE), F.lit(False)) & (F.col("error").isNotNull() | F.col("met").isNull())).head(1):
        return known.select("url").where("false")
    out = found.where(F.col("http_status").isin(*GONE)).select("url")
    if kept is not None:
        out = out.union(known.select("url").join(kept.select("url"), "url", "left_anti"))
    return known.select("url").join(out, "url", "left_semi")


def follow(config: Config, allowed: Sequence[str]):
    """A filter of candidate links by host and path."""
    return lambda links: links.where(U.is_allowed(F.col("url"), allowed) & U.is_page(F.col("url"), config.included_paths, config.excluded_paths))
