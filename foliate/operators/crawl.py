"""Breadth-first traversal of a link graph, level by level.

Each level is a DataFrame: the frontier is joined with the pages (a fetch), the
links of what was found are made absolute and canonical, filtered, and anti-
joined with everything visited. A page reached from several parents of one
level gets the first by (root, parent url, link position), so results do not
depend on timing. A level is written to the shared folder, which keeps plans
short and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage

_FRONTIER = ["url", "depth", "root", "root_order", "parent_url", "breadcrumb"]


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_depth: int, follow: Callable[[DataFrame], DataFrame] = lambda links: links) -> DataFrame:
    """All pages reached: url, depth, root, root_order, parent_url, breadcrumb and the columns that fetch adds.

    seeds: url (canonical), root (folder), root_order. fetch: frontier -> the frontier's rows with title, children
    (array of canonical urls in link order, null for none) and anything else; rows without content keep nulls.
    follow: filters and rewrites candidate links (column url), before anything is fetched.
    """
    frontier = seeds.groupBy("url").agg(F.min(F.struct("root_order", "root")).alias("r"))
    frontier = frontier.select(
        "url", F.lit(1).alias("depth"), "r.root", "r.root_order", F.lit(None).cast("string").alias("parent_url"), F.array().cast("array<string>").alias("breadcrumb")
    )
    frontier = storage.save(frontier, "frontier")
    visited, levels = frontier.select("url"), []
    for depth in range(1, max_depth + 1):
        level = storage.save(fetch(frontier), "level")
        levels.append(level)
        if depth == max_depth:
            break
        crumbs = F.when(F.coalesce("title", F.lit("")) != "", F.concat("breadcrumb", F.array("title"))).otherwise(F.col("breadcrumb"))
        links = level.select("root", "root_order", F.col("url").alias("parent_url"), crumbs.alias("breadcrumb"), F.posexplode("children").alias("position", "url"))
        links = follow(links).where("url is not null")
        # least parent first, then its breadcrumb by a join, so that no row carries more than it needs
        least = links.groupBy("url").agg(F.min(F.struct("root_order", "parent_url", "position")).alias("m")).join(visited, "url", "left_anti")
        parents = level.select(F.col("url").alias("parent_url"), "root", crumbs.alias("breadcrumb"))
        frontier = least.select("url", F.lit(depth + 1).alias("depth"), "m.root_order", "m.parent_url").join(parents, "parent_url").select(_FRONTIER)
        frontier = storage.save(frontier, "frontier")
        if not frontier.head(1):
            break
        visited = visited.union(frontier.select("url"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def from_store(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetch from a table of pages: url (canonical) and what else they have."""
    return lambda frontier: frontier.join(pages, "url", "left")


def crawl_store(seeds: DataFrame, pages: DataFrame, max_depth: int, follow: Callable[[DataFrame], DataFrame] = lambda links: links, light: tuple[str, ...] = ("title", "children")) -> DataFrame:
    """crawl() over a table of pages: url (canonical, distinct), title, children and what else they have.

    Levels read the light columns alone, bucketed by url, so no level shuffles the store; the other columns of the pages
    that were found are joined once at the end.
    """
    store, drop = storage.bucketed(pages.select("url", *light), "pages", "url")
    try:
        found = storage.save(crawl(seeds, from_store(store), max_depth, follow), "reached")
    finally:
        drop()
    heavy = [c for c in pages.columns if c not in light]
    return found.join(pages.select(heavy), "url", "left") if len(heavy) > 1 else found


def status(content: str = "markdown", error: str = "error"):
    """ok, skipped (no content) or error of a fetched page."""
    return F.when(F.col(error).isNotNull(), "error").when(F.coalesce(F.col(content), F.lit("")) == "", "skipped").otherwise("ok")


def stats(rows: DataFrame) -> DataFrame:
    """One row of counters from the column status."""
    count = lambda *names: F.count_if(F.col("status").isin(*names)).alias(names[0])
    return rows.agg(count("ok", "new", "changed"), count("unchanged"), count("skipped"), count("error"))
