"""URL and path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.text import MAX_TEXT, null_if_empty, or_empty, strip_space

ROOT = "/"


# Host without "www.", then everything up to a query, a fragment or the end.
_HTTP_URL = r"(?i)^https?://(?=[^/:?#])(?:www\.)?+([^/:?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-cased host without ``www.``; null unless the URL is http(s)."""
    hosts = F.regexp_extract_all(strip_space(url), F.lit(_HTTP_URL), F.lit(1))
    return F.lower(F.try_element_at(hosts, F.lit(1)))


def url_path(url: Column) -> Column:
    """Everything after the host (a port stays in), never null, ``/`` when empty.

    A non-empty rest starts with ``/`` or ``:``, so the larger of it and ``/`` is the path.
    """
    tail = F.regexp_extract(strip_space(or_empty(url)), _HTTP_URL, 2)
    single = F.when(tail.contains("//"), F.regexp_replace(tail, r"/{2,}", "/")).otherwise(tail)
    return F.greatest(F.rtrim(single, F.lit(ROOT)), F.lit(ROOT))


def after_scheme(url: Column) -> Column:
    """What follows ``http://`` or ``https://`` up to a query or fragment; null for other URLs or without a host.

    With ``authority``, ``host_of`` and ``path_of`` the same as ``url_host`` and ``url_path``, by plain string functions, for
    stripped URLs in columns of their own: a step each, so that no expression is repeated within another.
    """
    https = F.lower(F.substring(url, 1, 8)) == "https://"
    http = F.lower(F.substring(url, 1, 7)) == "http://"
    rest = F.when(https, F.substring(url, 9, MAX_TEXT)).when(http, F.substring(url, 8, MAX_TEXT))
    return F.substring_index(F.substring_index(rest, "?", 1), "#", 1)


def authority(rest: Column) -> Column:
    """Host and ``www.`` of what follows the scheme; null if there is none."""
    host = F.substring_index(F.substring_index(rest, ROOT, 1), ":", 1)
    return null_if_empty(host)


def host_of(authority: Column) -> Column:
    host = F.lower(authority)
    return F.when(host.startswith("www."), F.substring(host, 5, MAX_TEXT)).otherwise(host)


def path_of(rest: Column, authority: Column) -> Column:
    """The rest behind the host, with single slashes and without one at its end."""
    tail = F.substring(rest, F.length(authority) + 1, F.lit(MAX_TEXT))
    return F.when(tail.contains("//"), F.regexp_replace(tail, r"/{2,}", "/")).otherwise(or_empty(tail))


def or_root(path: Column) -> Column:
    return F.greatest(F.when(path.endswith(ROOT), F.rtrim(path, F.lit(ROOT))).otherwise(path), F.lit(ROOT))


def _pieces(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"^/", ""), "/", -1)


def parent_path(path: Column) -> Column:
    up = F.regexp_replace(path, r"/[^/]+$", "")
    return F.when(path == ROOT, F.lit(None).cast("string")).when(up == "", F.lit(ROOT)).otherwise(up)


def path_depth(path: Column) -> Column:
    return F.when(path == ROOT, F.lit(0)).otherwise(F.size(_pieces(path))).cast("int")


def path_section(path: Column) -> Column:
    return F.when(path == ROOT, F.lit("root")).otherwise(F.element_at(_pieces(path), 1))


def path_cluster(path: Column) -> Column:
    """``section:second piece``; ``__root__`` stands in for a missing second piece."""
    second = F.coalesce(F.try_element_at(_pieces(path), F.lit(2)), F.lit("__root__"))
    return F.concat_ws(":", path_section(path), second)


def segment_pieces(path: Column) -> Column:
    """Non-empty pieces of a path whose query and fragment have been cut off."""
    bare = F.regexp_replace(F.regexp_replace(strip_space(path), r"(?s)#.*$", ""), r"(?s)\?.*$", "")
    return F.filter(F.split(bare, "/", -1), lambda piece: piece != "")


def normalize_segment_path(path: Column) -> Column:
    """Leading slash, single slashes, no trailing slash, no query, no fragment."""
    return F.concat(F.lit(ROOT), F.array_join(segment_pieces(path), "/"))


def page_category(cluster: Column) -> Column:
    """Text after the first ``:`` of a cluster; null when there is none."""
    return null_if_empty(F.regexp_extract(cluster, r":(.+)$", 1))


def block_category(cluster: Column) -> Column:
    """Text after the last ``:`` of a cluster; the whole cluster when there is none."""
    return F.element_at(F.split(cluster, ":", -1), -1)
