"""String converters as native Column expressions. Null in, null out; a failed conversion is null (NaN for floats)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.validate import Text, _c, _float_head, _quoted, is_float

# Characters that escape() writes as references, the ampersand first.
REFERENCES = (("&", "&amp;"), ('"', "&quot;"), ("'", "&#x27;"), ("<", "&lt;"), (">", "&gt;"), ("/", "&#x2F;"), ("\\", "&#x5C;"), ("`", "&#96;"))


def blacklist(value: Text, chars: str) -> Column:
    """Without the characters of a class, given as inside brackets of a regular expression."""
    return F.regexp_replace(_c(value), f"[{chars}]+", "")


def whitelist(value: Text, chars: str) -> Column:
    return F.regexp_replace(_c(value), f"[^{chars}]+", "")


def strip_low(value: Text, keep_new_lines: bool = False) -> Column:
    return blacklist(value, r"\x00-\x09\x0B\x0C\x0E-\x1F\x7F" if keep_new_lines else r"\x00-\x1F\x7F")


def ltrim(value: Text, chars: str | None = None) -> Column:
    return F.regexp_replace(_c(value), f"^[{_quoted(chars)}]+" if chars else r"(?U)^\s+", "")


def rtrim(value: Text, chars: str | None = None) -> Column:
    return F.regexp_replace(_c(value), f"[{_quoted(chars)}]+$" if chars else r"(?U)\s+$", "")


def trim(value: Text, chars: str | None = None) -> Column:
    return rtrim(ltrim(value, chars), chars)


def escape(value: Text) -> Column:
    out = _c(value)
    for char, reference in REFERENCES:
        out = F.replace(out, F.lit(char), F.lit(reference))
    return out


def unescape(value: Text) -> Column:
    out = _c(value)
    for char, reference in (*REFERENCES[1:], REFERENCES[0]):
        out = F.replace(out, F.lit(reference), F.lit(char))
    return out


def to_boolean(value: Text, strict: bool = False) -> Column:
    v = _c(value)
    return (v == "1") | (F.lower(v) == "true") if strict else ~(v.isin("0", "") | (F.lower(v) == "false"))


def to_int(value: Text, radix: int = 10) -> Column:
    """The integer that the text begins with, in a radix from 2 to 36; null if there is none or it exceeds a long."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    v = F.lower(F.regexp_replace(_c(value), r"(?U)^\s+", ""))
    if radix == 16:
        v = F.regexp_replace(v, "^([+-]?)0x", "$1")
    head = F.nullif(F.regexp_extract(v, f"^([+-]?[{digits}]+)", 1), F.lit(""))
    if radix == 10:
        return head.try_cast("bigint")
    bare = F.regexp_replace(head, "^[+-]", "")
    return F.when(F.length(F.regexp_replace(bare, "^0+", "")) <= 12, F.conv(bare, radix, 10).try_cast("bigint") * F.when(head.startswith("-"), F.lit(-1)).otherwise(F.lit(1)))


def to_float(value: Text) -> Column:
    v = _c(value)
    return F.when(is_float(v), F.coalesce(_float_head(v), F.lit(float("nan")))).when(v.isNotNull(), F.lit(float("nan")))


def to_string(value: Text) -> Column:
    return F.coalesce(_c(value).cast("string"), F.lit(""))


def to_date(value: Text) -> Column:
    """ISO dates and times; null if the text is none. The session's time zone holds where the text has none."""
    return F.try_to_timestamp(F.trim(_c(value)))
