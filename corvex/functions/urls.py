"""URL expressions. Prefix tests are on raw strings, so the path /doc also admits /docs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug

# Endings of paths that are no pages.
STATIC = ".pdf .zip .tar .gz .png .jpg .jpeg .gif .svg .webp .ico .mp4 .mp3 .css .js".split()


def normalised(u: Column) -> Column:
    """Without fragment and trailing slashes; the query stays."""
    return F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "/+$", "")


def base(u: Column) -> Column:
    """scheme://host:port"""
    return F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def host(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def valid(u: Column) -> Column:
    return F.coalesce(u.rlike(r"^https?://[^/?#]+"), F.lit(False))


def url_slug(u: Column, empty: str = "web-page") -> Column:
    """Of host and path. Four fallbacks are in use: web-site, web-page, the empty string, page."""
    return slug(F.concat(host(u), path(u)), empty)


def admissible(u: Column, start: Column) -> Column:
    """Under the start's site and path, and no static file."""
    start_path = F.regexp_replace(path(start), "/+$", "")
    static = "(?i)(" + "|".join(s.replace(".", r"\.") for s in STATIC) + ")$"
    return F.startswith(u, base(start)) & F.startswith(path(u), start_path) & ~path(u).rlike(static)


def resolved(page: Column, href: Column) -> Column:
    """href seen from page: absolute, host-relative, root-relative, or relative to the page's folder; ./ and ../ at its start are followed."""
    folder = F.concat(base(page), F.when(path(page) == "", "/").otherwise(F.regexp_replace(path(page), "[^/]*$", "")))
    scheme = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.\\-]*:)", 1)
    plain = F.regexp_replace(href, r"^(\./)+", "")
    up = F.concat(F.regexp_replace(folder, r"([^/])/[^/]+/$", "$1/"), F.regexp_replace(plain, r"^\.\./", ""))
    page_only = F.regexp_replace(page, r"[?#].*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(base(page), href))
        .when(F.startswith(href, F.lit("?")), F.concat(page_only, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(page, "#.*$", ""), href))
        .when(F.startswith(plain, F.lit("../")), up)
        .otherwise(F.concat(folder, plain))
    )
