"""Query strings in their flat form, natively: pairs, and a map from key to all its values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def query_part(url: Column | str) -> Column:
    """What stands between ? and #; empty if there is none."""
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def decode(part: Column | str) -> Column:
    """+ becomes a space, %XX its character; text with malformed escapes stays as it is but for +."""
    v = _c(part)
    return F.coalesce(F.try_url_decode(v), F.replace(v, F.lit("+"), F.lit(" ")))


def encode(part: Column | str, plus: bool = False) -> Column:
    """Percent-encoding by RFC 3986; with plus, RFC 1738 (spaces as +)."""
    v = F.replace(F.replace(F.url_encode(_c(part)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return v if plus else F.replace(v, F.lit("+"), F.lit("%20"))


def pairs(query: Column | str, delimiter: str = "&", limit: int = 1000) -> Column:
    """Decoded pairs in order, the first `limit` ones: array of struct(key, value). A key without = has an empty value; empty parts go."""
    parts = F.slice(F.filter(F.split(F.regexp_replace(_c(query), r"^\?", ""), f"[{delimiter}]", -1), lambda p: p != ""), 1, limit)
    return F.transform(parts, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("key"), decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value")))


def parse_flat(query: Column | str, delimiter: str = "&", limit: int = 1000) -> Column:
    """Map from key to its values in order; keys in order of first appearance."""
    own = pairs(query, delimiter, limit)
    keys = F.array_distinct(F.transform(own, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(own, lambda p: p["key"] == k), lambda p: p["value"])))


def stringify_flat(values: Column | str, delimiter: str = "&") -> Column:
    """A map from key to values as a query string, keys repeated."""
    return F.array_join(F.flatten(F.transform(F.map_entries(_c(values)), lambda e: F.transform(e["value"], lambda v: F.concat(encode(e["key"]), F.lit("="), encode(v))))), delimiter)
