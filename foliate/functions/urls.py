"""URLs: canonical form, hosts, scope predicates, file names."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slug, strip

_ACTIONS = ("viewpage.action", "releaseview.action")


def _text(url: Column) -> Column:
    """Stripped, with https:// put in front of what has no scheme. host:port is no scheme."""
    url = strip(url)
    schemed = url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~url.rlike(r"^[^/?#:]+:[0-9]+([/?#]|$)")
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(schemed, url).otherwise(F.concat(F.lit("https://"), url))


def _host(text: Column) -> Column:
    named = F.regexp_extract(text, r"(?s)^[^:/?#]+://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(named, r"(?s)^.*@", ""), r":[0-9]*$", "")
    return F.lower(F.regexp_replace(bare, r"[\[\]]", ""))


def _path(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"(?s)^[^:/?#]+:(//[^/?#]*)?([^?#]*)", 2), r"(?s);[^/]*$", "")


def _query(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)


def host(url: Column) -> Column:
    """Lower-cased host without user and port; empty where there is none."""
    return _host(_text(url))


def path(url: Column) -> Column:
    """As written, without ;parameters of the last segment."""
    return _path(_text(url))


def query(url: Column) -> Column:
    return _query(_text(url))


def page_id(url: Column, key: str = "pageId") -> Column:
    """Digits of the page parameter, in any case of its name; null without it."""
    found = F.regexp_extract(url, rf"(?i)[?&]{key}=([0-9]+)", 1)
    return F.when(found != "", found)


def canonical(url: Column, allowed: Sequence[str] = (), preferred: str | None = None) -> Column:
    """https, host in lower case (the preferred one for any allowed), no user, port, trailing
    slashes, parameters or fragment. View actions keep the pageId of their query alone."""
    # a lambda names the parts, so that each is taken once and code stays small
    parts = F.transform(F.array(_text(url)), lambda t: F.struct(_host(t).alias("h"), F.regexp_replace(_path(t), r"/+$", "").alias("p"), _query(t).alias("q"), t.rlike(r"^[^:/?#]+://").alias("a")))

    def whole(x: Column) -> Column:
        name = x["h"]
        if allowed:
            name = F.when(name.isin(*allowed), F.lit(preferred if preferred is not None else allowed[0])).otherwise(name)
        wanted = F.regexp_extract(x["q"], r"(?:^|&)pageId=([^&]+)", 1)
        action = x["p"].endswith(_ACTIONS[0]) | x["p"].endswith(_ACTIONS[1])
        asked = F.when(action, F.when(wanted != "", F.concat(F.lit("pageId="), wanted)).otherwise("")).otherwise(x["q"])
        start = F.when(x["a"], F.concat(F.lit("https://"), name)).otherwise(F.lit("https:"))
        return F.concat(start, x["p"], F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))

    return F.element_at(F.transform(parts, whole), 1)


def is_allowed(url: Column, allowed: Sequence[str]) -> Column:
    return host(url).isin(*allowed) if allowed else F.lit(False)


def is_page(url: Column, included: Sequence[str], excluded: Sequence[str]) -> Column:
    """Whether the path starts with an included prefix (or is it, without its last slash) and with no excluded one."""
    own = path(url)
    some, none = F.lit(False), F.lit(True)
    for prefix in included:
        some = some | own.startswith(prefix) | (own == prefix.rstrip("/"))
    for prefix in excluded:
        none = none & ~own.startswith(prefix)
    return some & none


def is_web(href: Column) -> Column:
    """Relative, http or https."""
    return ~href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | href.rlike(r"(?i)^https?:")


def safe_name(title: Column, url: Column) -> Column:
    """File name from the title, else page-<id>, else the path, else untitled."""
    by_id = F.concat(F.lit("page-"), page_id(url))
    by_path = slug(F.regexp_replace(path(url), "/", "-"), 100)
    empty = lambda c: F.when(c != "", c)
    return F.coalesce(empty(slug(F.coalesce(title, F.lit("")), 100)), by_id, empty(by_path), F.lit("untitled"))


def root_name(url: Column) -> Column:
    """Folder of a root: page-<id>, else its last path segment, else docs."""
    last = F.try_element_at(F.filter(F.split(path(url), "/"), lambda x: x != ""), F.lit(-1))
    return F.coalesce(F.concat(F.lit("page-"), page_id(url)), slug(last, 80), F.lit("docs"))


def join(base: Column, href: Column) -> Column:
    """Absolute form of a link. Root-relative and absolute links stay in the JVM; others take an Arrow UDF."""
    origin = F.regexp_extract(base, r"(?s)^([^:/?#]+://[^/?#]*)", 1)
    root = href.startswith("/") & ~href.startswith("//") & ~href.contains("/.") & (origin != "")
    absolute = href.rlike(r"(?i)^https?://[^/?#]+(/|$)") & ~href.contains("/.")
    simple = F.when(absolute, href).when(root, F.concat(origin, href))
    return F.coalesce(simple, _urljoin(F.when(simple.isNull(), base), F.when(simple.isNull(), href)))


@F.pandas_udf(T.StringType())
def _urljoin(base: pd.Series, href: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    def one(b, h):
        if b is None or h is None:
            return None
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)
