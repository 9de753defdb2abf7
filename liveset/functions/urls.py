"""URL columns: splitting, canonical form, site test, resolving links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liveset.functions.text import col

# RFC 3986, appendix B
URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def url_part(c: Column | str, part: str) -> Column:
    group = {"scheme": 1, "host": 2, "path": 3, "query": 4}[part]
    value = F.regexp_extract(col(c), URL, group)
    return F.lower(value) if part == "scheme" else value


def canonical_url(c: Column | str) -> Column:
    """Fragment dropped; only ``page`` parameters kept, in order."""
    pages = F.filter(F.split(url_part(c, "query"), "&"), lambda p: F.substring_index(p, "=", 1) == "page")
    query = F.when(F.size(pages) > 0, F.concat(F.lit("?"), F.array_join(pages, "&"))).otherwise("")
    return F.concat(url_part(c, "scheme"), F.lit("://"), url_part(c, "host"), url_part(c, "path"), query)


def is_internal(c: Column | str, host: Column | str) -> Column:
    """Same host over http(s). Mail and script links never count as pages."""
    host = F.lit(host) if isinstance(host, str) else host
    return url_part(c, "scheme").isin("http", "https") & (url_part(c, "host") == host)


def _without_dots(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when((s == "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .when(s == "..", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of ``href`` found on page ``base``."""
    base, href = col(base), col(href)
    scheme, host, path = (url_part(base, p) for p in ("scheme", "host", "path"))
    origin = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    href_path = url_part(href, "path")
    tail = F.substring(href, F.length(href_path) + 1, F.length(href))
    absolute_path = F.when(href_path.startswith("/"), href_path).otherwise(F.concat(folder, href_path))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(origin, _without_dots(absolute_path), tail))
    )
