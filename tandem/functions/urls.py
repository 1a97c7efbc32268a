"""Hosts, paths and slugs of URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_WORK_PATH = rf"(?i)^(?:/(?:{'|'.join(fv.DEAD_PREFIXES)}))?/novela/([^/]+)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def host_of(url: Column | str) -> Column:
    """Host in lower case without ``www.``; '' when there is none."""
    host = F.lower(F.regexp_extract(F.trim(F.coalesce(_col(url), F.lit(""))), _HOST, 1))
    return F.regexp_replace(host, r"^www\.", "")


def origin_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1))


def path_of(url: Column | str) -> Column:
    """Path of an absolute URL, ``/`` when it has none, without query and fragment."""
    path = F.regexp_extract(_col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def is_http(url: Column | str) -> Column:
    return F.coalesce(_col(url), F.lit("")).rlike("(?i)^https?://")


def host_suffixes(host: Column) -> Column:
    """A host and its parent domains: a.b.c gives [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def decode(c: Column) -> Column:
    """Percent-decoding that keeps ``+`` and leaves malformed input as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)


def slug_in_path(path: Column | str) -> Column:
    """Slug of a work path, with or without a language prefix; NULL when it is no work path."""
    raw = F.nullif(F.regexp_extract(_col(path), _WORK_PATH, 1), F.lit(""))
    return F.lower(F.trim(decode(raw)))


def slug_in_url(url: Column | str) -> Column:
    """Slug of a work URL, work path or bare slug."""
    url = _col(url)
    path = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+", "")
    bare = F.lower(F.trim(F.regexp_replace(path, "^/+|/+$", "")))
    return F.coalesce(slug_in_path(path), F.when(~bare.contains("/"), bare))
