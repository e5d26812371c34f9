"""URL expressions: authority, resolution against a base, canonical form, site test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import EXCLUDED_PATHS, EXCLUDED_SCHEMES
from .text import col, contains_any, let, starts_with_any

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def authority(url: Column | str) -> Column:
    """Host with port and user part, '' if there is none."""
    return F.regexp_extract(col(url), AUTHORITY, 1)


def canonical_url(url: Column | str) -> Column:
    """Cut at the first '?' and drop trailing slashes; the fragment stays."""
    return F.regexp_replace(F.split_part(col(url), F.lit("?"), F.lit(1)), "/+$", "")


def _without_dots(path: Column, merged: Column) -> Column:
    """Resolve '.' and '..'; drop inner empty segments of a path ``merged`` from two."""

    def resolve(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
        segments = F.concat(F.filter(inner, lambda s: ~merged | (s != "")), F.array(last))
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        end = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))

    return let(F.split(path, "/"), resolve)


def _base_parts(base: Column) -> Column:
    """scheme, authority, origin, path, query and folder of a base URL."""
    path = F.regexp_extract(base, ORIGIN + r"([^?#]*)", 2)
    folder = F.regexp_replace(path, "[^/]*$", "")
    return F.struct(
        F.lower(F.regexp_extract(base, SCHEME, 1)).alias("scheme"),
        authority(base).alias("authority"),
        F.regexp_extract(base, ORIGIN, 1).alias("origin"),
        path.alias("path"),
        F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
        F.when(folder == "", F.lit("/")).otherwise(folder).alias("folder"),
        base.alias("whole"),
    )


def _join(b: Column, path: Column, tail: Column) -> Column:
    """Relative reference, split into path and query with fragment, put on base ``b``."""
    merged = ~path.startswith("/")

    def whole(full: Column) -> Column:
        dotted = full.contains("/.") | full.contains("//")
        clean = F.when(dotted, _without_dots(full, merged)).otherwise(full)
        return F.concat(b["origin"], clean, tail)

    on_path = let(F.when(merged, F.concat(b["folder"], path)).otherwise(path), whole)
    return (
        F.when(path != "", on_path)
        .when(tail.startswith("?"), F.concat(b["origin"], b["path"], tail))
        .otherwise(F.concat(b["origin"], b["path"], b["query"], tail))
    )


def _resolve(b: Column, href: Column) -> Column:
    tidy = F.regexp_replace(F.regexp_replace(href, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")

    def relative(rest: Column) -> Column:
        path = F.regexp_extract(rest, r"^([^?#]*)", 1)
        tail = F.regexp_extract(rest, r"(?s)^[^?#]*(.*)$", 1)
        parts = let(F.struct(path.alias("p"), tail.alias("t")), lambda x: _join(b, x["p"], x["t"]))
        return F.when(rest.startswith("//"), F.concat(b["scheme"], F.lit(":"), rest)).otherwise(parts)

    def absolute(x: Column) -> Column:
        h, own = x["h"], x["own"]
        rest = F.when(own == "", h).otherwise(F.regexp_replace(h, SCHEME, ""))
        return (
            F.when(h == "", b["whole"])
            .when((own != "") & (own != b["scheme"]), h)
            .otherwise(let(rest, relative))
        )

    def with_scheme(h: Column) -> Column:
        own = F.lower(F.regexp_extract(h, SCHEME, 1))
        return let(F.struct(h.alias("h"), own.alias("own")), absolute)

    return let(tidy, with_scheme)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of ``href`` as a link on a page at ``base``."""
    return let(_base_parts(col(base)), lambda b: _resolve(b, col(href)))


def followable(href: Column | str) -> Column:
    """False for mail and script links."""
    return ~starts_with_any(col(href), EXCLUDED_SCHEMES)


def _belongs(host: Column, site: Column, mode: str) -> Column:
    if mode == "suffix":
        return host.endswith(site)
    if mode == "exact":
        return host == site
    raise ValueError(f"unknown site mode {mode!r}")


def same_site(url: Column | str, base: Column | str, mode: str = "suffix") -> Column:
    """Does ``url`` belong to the site of ``base``? ``suffix`` also accepts sub-domains."""
    return _belongs(authority(url), authority(base), mode)


def is_article_link(url: Column | str) -> Column:
    """False for video, gallery, tag and author pages."""
    return ~contains_any(col(url), EXCLUDED_PATHS)


def site_links(base: Column | str, hrefs: Column, mode: str = "suffix") -> Column:
    """Distinct canonical links of one page that stay on the site of ``base``."""

    def links(b: Column) -> Column:
        full = F.transform(F.filter(hrefs, followable), lambda h: _resolve(b, h))
        kept = F.filter(full, lambda u: _belongs(authority(u), b["authority"], mode))
        return F.array_distinct(F.transform(kept, canonical_url))

    return let(_base_parts(col(base)), links)
