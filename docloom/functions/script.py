"""What scripts do to strings, numbers, arrays and objects, as native Column expressions.

Positions begin with 0, negative ones count from the end, as in scripts. Null gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str


def _c(value: Value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _bound(position: int | None, size: Column, default: Column) -> Column:
    """A slice's edge: counted from the end if negative, within the value."""
    if position is None:
        return default
    return F.greatest(size + position, F.lit(0)) if position < 0 else F.least(F.lit(position), size)


# -- strings -------------------------------------------------------------------


def char_at(value: Value, at: int) -> Column:
    return F.substring(_c(value), at + 1, 1) if at >= 0 else F.when(_c(value).isNotNull(), F.lit(""))


def char_code_at(value: Value, at: int) -> Column:
    """The code point there; null beyond the end."""
    c = char_at(value, at)
    return F.when(c != "", F.ascii(c))


def index_of(value: Value, part: str) -> Column:
    return F.instr(_c(value), part) - 1 if part else F.when(_c(value).isNotNull(), F.lit(0))


def last_index_of(value: Value, part: str) -> Column:
    v = _c(value)
    back = F.instr(F.reverse(v), part[::-1])
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(v) - back - len(part) + 1) if part else F.length(v)


def includes(value: Value, part: str) -> Column:
    return _c(value).contains(part)


def starts_with(value: Value, part: str, at: int = 0) -> Column:
    return F.substring(_c(value), at + 1, 1 << 30).startswith(part)


def ends_with(value: Value, part: str) -> Column:
    return _c(value).endswith(part)


def sliced(value: Value, start: int = 0, end: int | None = None) -> Column:
    v = _c(value)
    size = F.length(v)
    a, b = _bound(start, size, F.lit(0)), _bound(end, size, size)
    return F.substring(v, a + 1, F.greatest(b - a, F.lit(0)))


def substring(value: Value, start: int, end: int | None = None) -> Column:
    """Negative edges count as 0, and the smaller edge comes first."""
    if end is None:
        return sliced(value, max(start, 0))
    a, b = sorted((max(start, 0), max(end, 0)))
    return sliced(value, a, b)


def split(value: Value, by: str) -> Column:
    v = _c(value)
    return F.filter(F.split(v, ""), lambda x: x != "") if by == "" else F.split(v, F.lit(r"\Q" + by + r"\E"), F.lit(-1))


def replaced(value: Value, part: str, by: str) -> Column:
    """The first occurrence alone."""
    v = _c(value)
    at = F.instr(v, part)
    return F.when(at == 0, v).otherwise(F.concat(F.substring(v, F.lit(1), at - 1), F.lit(by), F.substring(v, at + len(part), F.lit(1 << 30))))


def replaced_all(value: Value, part: str, by: str) -> Column:
    return F.replace(_c(value), F.lit(part), F.lit(by))


def padded_start(value: Value, size: int, by: str = " ") -> Column:
    v = _c(value)
    return F.when(F.length(v) >= size, v).otherwise(F.lpad(v, size, by)) if by else v


def padded_end(value: Value, size: int, by: str = " ") -> Column:
    v = _c(value)
    return F.when(F.length(v) >= size, v).otherwise(F.rpad(v, size, by)) if by else v


def repeated(value: Value, times: int) -> Column:
    return F.repeat(_c(value), times)


def upper(value: Value) -> Column:
    return F.upper(_c(value))


def lower(value: Value) -> Column:
    return F.lower(_c(value))


def trimmed(value: Value) -> Column:
    return F.regexp_replace(_c(value), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


# -- numbers -------------------------------------------------------------------


def to_radix(value: Value, radix: int) -> Column:
    """A whole number in digits 0-9a-z."""
    v = _c(value).cast("long")
    digits = F.lower(F.conv(F.abs(v).cast("string"), 10, radix))
    return F.when(v < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def to_fixed(value: Value, digits: int = 0) -> Column:
    """With so many decimals; halves go away from zero."""
    return F.round(_c(value).cast("decimal(38,12)"), digits).cast(f"decimal(38,{digits})").cast("string")


#: The Math namespace.
MATH: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "expm1": F.expm1, "log": F.log, "log10": F.log10, "log2": F.log2, "log1p": F.log1p, "sin": F.sin, "cos": F.cos,
    "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "sign": F.signum, "max": F.greatest, "min": F.least, "pow": F.pow, "atan2": F.atan2, "hypot": F.hypot,
    "round": lambda v: F.floor(v + 0.5), "trunc": lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)),
}


def math(name: str, *values: Value) -> Column:
    return MATH[name](*[_c(v) for v in values])


# -- arrays --------------------------------------------------------------------


def array_slice(value: Value, start: int = 0, end: int | None = None) -> Column:
    v = _c(value)
    size = F.size(v)
    a, b = _bound(start, size, F.lit(0)), _bound(end, size, size)
    return F.slice(v, a + 1, F.greatest(b - a, F.lit(0)))


def array_splice(value: Value, start: int, remove: int, *add: Column) -> Column:
    v = _c(value)
    a = _bound(start, F.size(v), F.lit(0))
    b = F.least(a + remove, F.size(v))
    return F.concat(F.slice(v, F.lit(1), a), *([F.array(*add)] if add else []), F.slice(v, b + 1, F.size(v) - b))


def array_index_of(value: Value, item: Column) -> Column:
    return F.array_position(_c(value), item).cast("int") - 1


def array_find(value: Value, test: Callable[[Column], Column]) -> Column:
    """The first element that passes; null without one."""
    return F.try_element_at(F.filter(_c(value), test), F.lit(1))


def array_find_index(value: Value, test: Callable[[Column], Column]) -> Column:
    hits = F.filter(F.transform(_c(value), lambda x, i: F.when(F.coalesce(test(x), F.lit(False)), i)), lambda x: x.isNotNull())
    return F.coalesce(F.array_min(hits), F.when(_c(value).isNotNull(), F.lit(-1)))


def array_map(value: Value, f: Callable[[Column], Column]) -> Column:
    return F.transform(_c(value), f)


def array_filter(value: Value, test: Callable[[Column], Column]) -> Column:
    return F.filter(_c(value), test)


def array_reduce(value: Value, f: Callable[[Column, Column], Column], start: Column) -> Column:
    return F.aggregate(_c(value), start, f)


def array_some(value: Value, test: Callable[[Column], Column]) -> Column:
    return F.exists(_c(value), test)


def array_every(value: Value, test: Callable[[Column], Column]) -> Column:
    return F.forall(_c(value), test)


def array_joined(value: Value, by: str = ",") -> Column:
    """Null elements are empty."""
    return F.array_join(F.transform(_c(value), lambda x: x.cast("string")), by, "")


def array_sorted(value: Value) -> Column:
    """By the elements' strings, as scripts sort without a comparison; nulls last."""
    pairs = F.transform(_c(value), lambda x: F.struct(x.isNull().alias("none"), x.cast("string").alias("key"), x.alias("item")))
    return F.transform(F.array_sort(pairs), lambda x: x["item"])


def array_reversed(value: Value) -> Column:
    return F.reverse(_c(value))


def array_pushed(value: Value, *items: Column) -> Column:
    return F.concat(_c(value), F.array(*items))


def array_unshifted(value: Value, *items: Column) -> Column:
    return F.concat(F.array(*items), _c(value))


def array_filled(value: Value, item: Column, start: int = 0, end: int | None = None) -> Column:
    v = _c(value)
    a, b = _bound(start, F.size(v), F.lit(0)), _bound(end, F.size(v), F.size(v))
    return F.transform(v, lambda x, i: F.when((i >= a) & (i < b), item).otherwise(x))


# -- objects and JSON -------------------------------------------------------------


def object_keys(value: Value) -> Column:
    return F.map_keys(_c(value))


def object_values(value: Value) -> Column:
    return F.map_values(_c(value))


def object_entries(value: Value) -> Column:
    return F.map_entries(_c(value))


def object_assigned(value: Value, *others: Value) -> Column:
    """Keys of later objects win."""

    def over(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)

    out = _c(value)
    for other in others:
        out = over(out, _c(other))
    return out


def object_from_entries(value: Value) -> Column:
    """Of an array of (key, value) structs."""
    return F.map_from_entries(_c(value))


def json_parsed(value: Value, schema: str) -> Column:
    """JSON as a value of the schema; null where it is malformed."""
    return F.from_json(_c(value), schema)


def json_of(value: Value) -> Column:
    return F.to_json(_c(value))


def json_type(value: Value) -> Column:
    """object, array, string, number, boolean or null; null where the JSON is malformed."""
    kind = F.schema_of_variant(F.try_parse_json(_c(value)))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
