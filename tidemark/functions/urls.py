"""URL and path expressions."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, no trailing slashes of the path, no fragment, no tracking parameters,
    the others sorted. Values are left as they are written."""
    u = F.regexp_replace(F.trim(c), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    keep = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING)))
    keep = F.transform(keep, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    q = F.array_join(keep, "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


@F.pandas_udf(StringType())
def safe_join_udf(base: pd.Series, ref: pd.Series) -> pd.Series:
    """The absolute form of a reference; null where either is malformed."""

    def one(b, r):
        try:
            urlsplit(joined := urljoin(b or "", r))
            return joined
        except (ValueError, TypeError, AttributeError):
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)])


def absolute_url(base: Column, ref: Column) -> Column:
    """Scheme-relative, root-relative and relative references; absolute ones stay."""
    origin = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*)", 1)
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .otherwise(F.concat(origin, F.lit("/"), F.regexp_replace(ref, "^[./]+", "")))
    )


def proxy_path(url: Column, prefix: str = "/v1/img/") -> Column:
    """URL-safe base64 without padding below a prefix."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.translate(F.base64(F.encode(url, "UTF-8")), "+/", "-_"), "[=\r\n]", ""))


def host_allowed(url: Column, host: str) -> Column:
    h = F.lower(F.regexp_extract(url, "^https?://([^/?#:]*)", 1))
    return (h == host) | h.endswith("." + host)


def admitted(url: Column) -> Column:
    """Why a URL may not be fetched: its scheme, port, a host of digits or a local name; null if it may."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#:]*)", 1))
    port = F.regexp_extract(url, "^[A-Za-z]+://[^/?#:]*:([0-9]+)", 1)
    return F.when(~scheme.isin("http", "https"), "scheme").when((port != "") & ~port.isin("80", "443"), "port").when((host == "localhost") | host.endswith(".local") | host.endswith(".internal"), "name").when(host.rlike(r"^(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.)"), "address")


def object_key(path: Column) -> Column:
    """The key of a published object, null for paths that leave the published tree."""
    bad = path.contains("..") | path.contains("//") | (F.length(path) > 512) | ~path.rlike("^/?v1/")
    p = F.regexp_replace(path, "^/", "")
    return F.when(~bad, F.when(p.rlike(r"\.[a-z0-9]+$"), p).otherwise(F.concat(p, F.lit(".json"))))


def evidence_key(source: Column, external: Column, digest: Column) -> Column:
    return F.concat(F.concat_ws("/", F.lit("raw"), source, external, F.substring(digest, 1, 16)), F.lit(".html"))


# Where the school's editor puts pictures, names it makes up itself, marks of copies, and names that say nothing.
UPLOAD_PATH = r"^https?://([^/?#:]+)[^/?#]*/upload/cross/images/(\d+)/([^?#]+)"
MADE_UP_NAME = r"^\d{17}_[0-9a-z]{8}$"
COPY_SUFFIX = r"(?:_\d{1,2})+$"
PLAIN_NAMES = ("unnamed", "image", "image001", "image002", "img", "poster", "본문")


def poster_keys(images: Column) -> Column:
    """Keys of an item's uploaded pictures (an array of absolute addresses): ``bucket:host/folder``, and ``file:host/folder/name``
    where the name is one that somebody gave. They are signs of a common poster, not proof of one."""

    def keys(url: Column) -> Column:
        host, folder, name = (F.regexp_extract(url, UPLOAD_PATH, k) for k in (1, 2, 3))
        stem = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.try_url_decode(name), name), r"\.[^.]*$", ""), COPY_SUFFIX, "")))
        place = F.concat(F.lower(host), F.lit("/"), folder)
        given = (F.length(stem) >= 6) & ~stem.isin(*PLAIN_NAMES) & ~stem.rlike(MADE_UP_NAME)
        both = F.array(F.when(folder != "", F.concat(F.lit("bucket:"), place)), F.when((folder != "") & given, F.concat(F.lit("file:"), place, F.lit("/"), stem)))
        return F.filter(both, lambda k: k.isNotNull())

    return F.array_distinct(F.flatten(F.transform(images, keys)))
