"""Nested query strings: keys with brackets become objects and arrays, and the way back."""

from __future__ import annotations

import json
import re
from urllib.parse import quote, unquote_to_bytes

_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_APPEND = object()
# Names that every object of a script has, and marks of the charset.
_INHERITED = frozenset("__defineGetter__ __defineSetter__ __lookupGetter__ __lookupSetter__ __proto__ constructor hasOwnProperty isPrototypeOf propertyIsEnumerable toLocaleString toString valueOf".split())
_SENTINELS = {"utf8=%E2%9C%93": "utf-8", "utf8=%26%2310003%3B": "iso-8859-1"}


def _index(key: str, array_limit: int) -> bool:
    return re.fullmatch(r"0|[1-9][0-9]{0,8}", key) is not None and int(key) < array_limit


def _limited(values: list, array_limit: int, strict: bool = False) -> list | dict:
    """An array of more than array_limit values is an object by place."""
    if len(values) <= array_limit:
        return values
    if strict:
        raise ValueError(f"more than {array_limit} values in an array")
    return {str(i): v for i, v in enumerate(values)}


class _Branch:
    """What stands under one key: values given to the key itself, and branches by key, index or turn."""

    __slots__ = ("values", "under", "listed", "empty")

    def __init__(self):
        self.empty = False  # an empty array was given
        self.values: list = []
        self.under: dict[str, _Branch] = {}
        self.listed: list[_Branch] = []  # branches of empty brackets

    def step(self, key) -> _Branch:
        if key is _APPEND:
            self.listed.append(_Branch())
            return self.listed[-1]
        return self.under.setdefault(key, _Branch())

    def value(self, array_limit: int, strict: bool = False):
        """Plain values; only called on branches whose children are already plain."""
        got = self._value(array_limit)
        return _limited(got, array_limit, strict) if isinstance(got, list) else got

    def _value(self, array_limit: int):
        under = {k: v for k, v in self.under.items()}
        numbered = all(_index(k, array_limit) for k in under)
        nested = None
        if under and numbered:
            nested = [under[k] for k in sorted(under, key=int)] + self.listed
        elif under:
            nested = {str(i): v for i, v in enumerate(self.listed)} | under
        elif self.listed:
            nested = list(self.listed)
        if not self.values:
            return [] if nested is None and self.empty else nested
        if nested is None:
            return self.values[0] if len(self.values) == 1 else self.values
        if isinstance(nested, list):
            return self.values + nested
        return [*self.values, nested]


def decoded(text: str, charset: str = "utf-8") -> str:
    """+ becomes a space, %XX its character; bytes that aren't of the charset leave the text as it is but for +."""
    text = text.replace("+", " ")
    if not _PERCENT.search(text):
        return text
    try:
        return unquote_to_bytes(text).decode(charset)
    except UnicodeDecodeError:
        return text


def numeric_entities(text: str) -> str:
    """&#N; becomes its character."""
    return re.sub(r"&#([0-9]{1,7});", lambda m: chr(int(m[1])) if int(m[1]) < 0x110000 else m[0], text)


def path(key: str, depth: int = 5, allow_dots: bool = False, strict: bool = False) -> list:
    """The steps of a key; brackets beyond `depth` are one last step as they stand, or an error if strict."""
    if allow_dots:
        key = re.sub(r"\.([^.\[]+)", r"[\1]", key)
    first = key.find("[")
    if first < 0 or depth <= 0:
        return [key]
    steps: list = [key[:first]] if first else []
    at = first
    while at < len(key) and key[at] == "[":
        stop = key.find("]", at)
        if stop < 0:
            break
        if len(steps) - (1 if first else 0) >= depth:
            if strict:
                raise ValueError(f"a key deeper than {depth}")
            steps.append(key[at:])
            return steps
        steps.append(key[at + 1 : stop] if stop > at + 1 else _APPEND)
        at = stop + 1
    if len(steps) == (1 if first else 0):
        return [key]
    return steps


def _pairs(query: str, delimiter: str | re.Pattern, limit: int, comma: bool, strict_nulls: bool, duplicates: str, charset: str, sentinel: bool, entities: bool, strict_limits: bool) -> list[tuple[str, list]]:
    """Decoded keys with their values, in order."""
    query = re.sub("%5D", "]", re.sub("%5B", "[", query.removeprefix("?"), flags=re.I), flags=re.I)
    parts = [p for p in (delimiter.split(query) if isinstance(delimiter, re.Pattern) else query.split(delimiter)) if p]
    if strict_limits and len(parts) > limit:
        raise ValueError(f"more than {limit} parameters")
    parts = parts[:limit]
    if sentinel:
        at = next((i for i, p in enumerate(parts) if p.startswith("utf8=")), None)
        if at is not None:
            charset = _SENTINELS.get(re.sub(r"\[", "%5B", parts.pop(at)), charset)
    out: list[tuple[str, list]] = []
    first: dict[str, int] = {}
    for part in parts:
        cut = part.find("]=")
        cut = part.find("=") if cut < 0 else cut + 1
        key, raw = (part, None) if cut < 0 else (part[:cut], part[cut + 1 :])
        key = decoded(key, charset)
        if not key:
            continue
        values: list = [None if strict_nulls else ""]
        if raw is not None:
            values = [decoded(x, charset) for x in (raw.split(",") if comma else [raw])]
        if entities and charset == "iso-8859-1":
            values = [numeric_entities(v) if v else v for v in values]
        if key in first and duplicates != "combine" and "[]=" not in part:
            if duplicates == "last":
                out[first[key]] = key, values
            continue
        first.setdefault(key, len(out))
        out.append((key, values))
    return out


def parse(
    query: str, depth: int = 5, array_limit: int = 20, parameter_limit: int = 1000, delimiter: str | re.Pattern = "&", allow_dots: bool = False, comma: bool = False, strict_nulls: bool = False, duplicates: str = "combine", arrays: bool = True,
    empty_arrays: bool = False, prototypes: bool = False, decode_dots: bool = False, charset: str = "utf-8", sentinel: bool = False, entities: bool = False, strict_depth: bool = False, strict_limits: bool = False,
) -> dict:
    """The nested value of a query string; a leading ? is ignored.

    a[b]=c nests; a[]= and indices below array_limit make arrays (holes close up); other indices, and more values
    than array_limit, make an object; a key given twice has all its values, or the first or last one (duplicates).
    A value before keys below it makes an array of the value and an object; after them it is a key of the object,
    true. arrays off: objects by index alone. empty_arrays: a[]= is an empty array. Keys that every object of a
    script has go unless prototypes allows them; __proto__ always goes. decode_dots: %2E in keys is a dot that
    doesn't nest. charset: utf-8 or iso-8859-1, or what a pair utf8= says (sentinel); entities: &#N; is a
    character under iso-8859-1. strict_depth, strict_limits: ValueError beyond depth or a limit.
    """
    top = _Branch()
    order: list[_Branch] = []
    array_limit = array_limit if arrays else 0
    for key, values in _pairs(query, delimiter, parameter_limit, comma, strict_nulls, duplicates, charset, sentinel, entities, strict_limits):
        steps = path(key, depth, allow_dots or decode_dots, strict_depth)
        if decode_dots:
            steps = [x if x is _APPEND else re.sub("%2E", ".", x, flags=re.I) for x in steps]
        if any(x in _INHERITED and (x == "__proto__" or not prototypes) for x in steps if x is not _APPEND):
            continue
        if not arrays:
            steps = ["0" if x is _APPEND else x for x in steps]
        elif empty_arrays and steps[-1] is _APPEND and values[0] in ("", None) and len(values) == 1:
            steps.pop()
            values = []
        branch = top
        for step in steps:
            branch = branch.step(step)
            order.append(branch)
        if not values:
            branch.empty = True
        elif branch.listed or (branch.under and all(_index(k, array_limit) for k in branch.under)):
            for value in values:
                order.append(branch.step(_APPEND))
                order[-1].values.append(value)
        elif branch.under and not branch.values and isinstance(values[0], str):
            for value in values:
                order.append(branch.step(value))
                order[-1].values[:] = order[-1].values or [True]
        else:
            branch.values.extend(values)
    # a branch begins before those under it, so from the back children are plain when their parent's turn comes
    plain: dict[int, object] = {}
    for branch in reversed(order):
        if id(branch) not in plain and not _open(branch, plain):
            plain[id(branch)] = _closed(branch, plain, array_limit if arrays else len(branch.values), strict_limits)
    return {k: plain[id(v)] for k, v in top.under.items()} | {str(i): plain[id(v)] for i, v in enumerate(top.listed)}


def _open(branch: _Branch, plain: dict[int, object]) -> bool:
    return any(id(v) not in plain for v in [*branch.under.values(), *branch.listed])


def _closed(branch: _Branch, plain: dict[int, object], array_limit: int, strict: bool):
    held = _Branch()
    held.values, held.empty = branch.values, branch.empty
    held.under = {k: plain[id(v)] for k, v in branch.under.items()}
    held.listed = [plain[id(v)] for v in branch.listed]
    return held.value(array_limit, strict)


def _escaped(text: str) -> str:
    """Percent-encoding for iso-8859-1; other characters as numeric entities of their UTF-16 units."""
    units = memoryview(text.encode("utf-16-le", "surrogatepass")).cast("H")
    return "".join(quote(bytes([u]), safe="@*_+-./") if u < 256 else f"%26%23{u}%3B" for u in units)


def stringify(
    value: dict | list, delimiter: str = "&", arrays: str = "indices", allow_dots: bool = False, encode: bool = True, plus: bool = False, keys: tuple[str, ...] | None = None, sort: bool = False, skip_nulls: bool = False, strict_nulls: bool = False,
    empty_arrays: bool = False, encode_dots: bool = False, values_only: bool = False, comma_round_trip: bool = False, charset: str = "utf-8", sentinel: bool = False, prefix: bool = False, depth: int | None = None,
) -> str:
    """The query string of a nested value. arrays: indices, brackets, repeat or comma. Null is an empty value; empty arrays and objects give nothing.

    keys: only these keys or indices, in this order, at every level; sort: keys by code point. skip_nulls leaves
    nulls out, strict_nulls writes their keys alone. empty_arrays: an empty array is key[]. encode_dots: dots in
    keys are %2E. values_only: keys stand as they are. comma_round_trip: an array of one value has [] under comma.
    sentinel: a first pair says the charset. prefix: a leading ?. depth: ValueError beyond it.
    """

    def coded(text: str) -> str:
        if charset == "iso-8859-1":
            return _escaped(text).replace("%20", "+") if plus else _escaped(text)
        return quote(text, safe="-._~") if not plus else quote(text, safe="-._~() ").replace(" ", "+")

    def spelled(x) -> str:
        if x is None:
            return ""
        return ("true" if x else "false") if isinstance(x, bool) else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":")) if isinstance(x, (dict, list)) else str(x)

    def undotted(key: str) -> str:
        return key.replace(".", "%2E") if encode_dots else key

    def children(now: dict | list) -> list[tuple[str, object]]:
        held = now if isinstance(now, dict) else {str(i): v for i, v in enumerate(now)}
        names = [k for k in keys if k in held] if keys is not None else sorted(held) if sort else list(held)
        return [(k, held[k]) for k in names if not (skip_nulls and held[k] is None)]

    def pair(key: str, text: str, own: bool = encode) -> str:
        return f"{key if values_only or not encode else coded(key)}={coded(text) if own else text}"

    out: list[str] = []
    wait = [(undotted(k), v, 0) for k, v in reversed(children(value))]
    while wait:
        key, now, at = wait.pop()
        if depth is not None and at > depth:
            raise ValueError(f"a value deeper than {depth}")
        if isinstance(now, dict):
            up = undotted(key)
            wait.extend((f"{up}.{undotted(k)}" if allow_dots else f"{up}[{k}]", v, at + 1) for k, v in reversed(children(now)))
        elif isinstance(now, list):
            up = undotted(key) + ("[]" if comma_round_trip and arrays == "comma" and len(now) == 1 else "")
            if not now:
                out.extend([up + "[]"] if empty_arrays else [])
            elif arrays == "comma":
                own = encode and values_only
                joined = ",".join(coded(spelled(v)) if own else spelled(v) for v in now)
                if joined or not (skip_nulls or strict_nulls):
                    out.append(pair(up, joined, encode and not own))
                elif not skip_nulls:
                    out.append(up if values_only or not encode else coded(up))
            else:
                names = {"indices": lambda i, up=up: f"{up}[{i}]", "brackets": lambda i, up=up: f"{up}[]", "repeat": lambda i, up=up: up}[arrays]
                wait.extend((names(i), v, at + 1) for i, v in reversed(children(now)))
        elif now is None and strict_nulls:
            out.append(key if values_only or not encode else coded(key))
        else:
            out.append(pair(key, spelled(now)))
    first = [next(k for k, v in _SENTINELS.items() if v == charset)] if sentinel else []
    return ("?" if prefix else "") + delimiter.join([*first, *out]) if out else ""


def parse_json(query: str, **options) -> str:
    return json.dumps(parse(query, **options), ensure_ascii=False, separators=(",", ":"))
