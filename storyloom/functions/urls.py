"""URL normalisation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.text import strip, text_or_empty



def normalize_url(c) -> Column:
    """Canonical article URL for de-duplication.

    Scheme and host in lower case, no fragment, no tracking parameters, query
    sorted by key (stable), no trailing slash below the root.  Text without
    scheme or host comes back trimmed.
    """
    raw = strip(text_or_empty(c))
    bare = F.regexp_extract(raw, r"^([^#]*)", 1)
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)", 1))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, r"/+$", "")).otherwise(path)

    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    keyed = F.transform(
        pairs,
        lambda p, i: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"),
            i.alias("i"),
            _decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    tracked = F.array(*[F.lit(p) for p in K.TRACKING_PARAMS])
    kept = F.array_sort(F.filter(keyed, lambda e: ~F.array_contains(tracked, F.lower(e["k"]))))
    clean = F.array_join(
        F.transform(kept, lambda e: F.concat(F.url_encode(e["k"]), F.lit("="), F.url_encode(e["v"]))), "&"
    )
    built = F.concat(
        scheme, F.lit("://"), host, path,
        F.when(clean != "", F.concat(F.lit("?"), clean)).otherwise(F.lit("")),
    )
    return F.when((scheme == "") | (host == ""), raw).otherwise(built)


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def drop_utm(c) -> Column:
    """Narrow variant: trailing slash and utm_ parameters only."""
    raw = F.regexp_replace(strip(text_or_empty(c)), r"/$", "")
    head = F.regexp_extract(raw, r"^([^?#]*)", 1)
    query = F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(raw, r"(#.*)$", 1)
    kept = F.array_join(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_"))), "&"
    )
    return F.concat(
        head, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")),
        F.when(fragment == "#", "").otherwise(fragment),
    )


def host_of(c) -> Column:
    """Lower-case network location without a leading www."""
    host = F.regexp_extract(F.lower(strip(text_or_empty(c))), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


