"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake import lexicons as L
from hirelake.functions.text import blank, strip


def netloc(url: str | Column) -> Column:
    """Host with port, as written; '' where a URL has none."""
    return F.regexp_extract(blank(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path(url: str | Column) -> Column:
    """Path of an absolute or relative URL, without query and fragment."""
    return F.regexp_extract(blank(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def same_org(a: str | Column, b: str | Column) -> Column:
    """Whether two hosts are equal or share their last two labels; empty hosts never are."""
    x, y = (F.lower(F.regexp_replace(blank(c), r":\d*$", "")) for c in (a, b))
    dotted = x.contains(".") & y.contains(".")
    return F.when((x == "") | (y == ""), False).otherwise((x == y) | (dotted & (F.substring_index(x, ".", -2) == F.substring_index(y, ".", -2))))


def base_parts(base: str | Column) -> Column:
    """What :func:`join_parts` needs of a base URL, as a struct to work out once per page."""
    b = blank(base)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(b, r"[?#].*$", "")
    folder = F.when(bare == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    return F.struct(scheme.alias("scheme"), root.alias("root"), bare.alias("bare"), folder.alias("folder"), F.regexp_replace(b, r"#.*$", "").alias("whole"))


def join_parts(parts: Column, href: Column) -> Column:
    """A stripped ``href`` seen from a base: absolute, scheme-relative, root-relative, query,
    fragment and directory-relative forms; one leading '..' and leading '.' are resolved."""
    root, folder = parts["root"], parts["folder"]
    up = F.concat(root, F.regexp_replace(F.substring(folder, F.length(root) + 1, F.length(folder)), r"[^/]*/$", ""))
    return (
        F.when(href == "", parts["whole"])
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(parts["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(parts["bare"], href))
        .when(href.startswith("#"), F.concat(parts["whole"], href))
        .when(href.startswith("../"), F.concat(up, F.substring(href, 4, 1 << 20)))
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^(\./)+", "")))
    )


def join_url(base: str | Column, href: str | Column) -> Column:
    return join_parts(base_parts(base), strip(blank(href)))


def normalize_url(raw: str | Column, blocked: list[str] = L.BLOCKED_HOSTS) -> Column:
    """scheme://host of a loosely written address; NULL for empty and blocked ones."""
    s = strip(blank(raw))
    full = F.when(s.startswith("//"), F.concat(F.lit("https:"), s)).when(s.startswith("http://") | s.startswith("https://"), s).otherwise(F.concat(F.lit("https://"), s))
    host = netloc(full)
    known = F.regexp_replace(F.lower(host), r"^www\.", "")
    return F.when((s != "") & (host != "") & ~known.isin(blocked), F.concat(F.regexp_extract(full, r"^(https?)", 1), F.lit("://"), host))


def redirect_target(href: str | Column) -> Column:
    """The address that a search result's redirect link carries, if any."""
    return F.call_function("try_url_decode", F.nullif(F.regexp_extract(blank(href), r"[?&]uddg=([^&#]*)", 1), F.lit("")))


def parent_path(url: str | Column) -> Column:
    """Path without its last two segments ('' where there are fewer)."""
    p = path(url)
    slashes = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    return F.when(slashes >= 2, F.regexp_replace(p, r"/[^/]*/[^/]*$", "")).when(slashes == 1, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(p)
