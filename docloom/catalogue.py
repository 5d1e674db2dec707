"""All queries of the library over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import addresses as A
from docloom.functions import convert as C
from docloom.functions import html as H
from docloom.functions import urlquery as Q
from docloom.functions import validate as V
from docloom.operators.graph import Graph

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


#: Strings of many kinds, valid in both dialects: columns of the tables as they are and made into numbers, and literals.
SAMPLES = """
SELECT url AS value FROM {pages}
UNION SELECT substring(url, 1, instr(concat(url, '?'), '?') - 1) FROM {pages}
UNION SELECT replace(replace(url, 'https://', ''), 'http://', '') FROM {pages}
UNION SELECT props FROM {events}
UNION SELECT event_type FROM {events}
UNION SELECT lang FROM {documents}
UNION SELECT text FROM {documents}
UNION SELECT text FROM {conversations}
UNION SELECT p_brand FROM {part} UNION SELECT p_type FROM {part} UNION SELECT p_name FROM {part}
UNION SELECT CAST(p_size AS STRING) FROM {part}
UNION SELECT CAST(o_orderkey AS STRING) FROM {orders}
UNION SELECT lpad(CAST(o_orderkey * 7919 AS STRING), 8, '4') FROM {orders}
UNION SELECT lpad(CAST(o_orderkey * 7919 AS STRING), 9, '0') FROM {orders}
UNION SELECT lpad(CAST(o_orderkey * 104729 AS STRING), 10, '0') FROM {orders}
UNION SELECT lpad(CAST(o_orderkey * 104729 AS STRING), 13, '978') FROM {orders}
UNION SELECT lpad(CAST(o_orderkey * 104729 AS STRING), 14, '1') FROM {orders}
UNION SELECT lpad(CAST(o_orderkey * 104729 AS STRING), 15, '35') FROM {orders}
UNION SELECT lpad(CAST(o_orderkey * 104729 AS STRING), 16, '4') FROM {orders}
UNION SELECT concat('CSQU', lpad(CAST(o_orderkey * 79 AS STRING), 7, '3')) FROM {orders}
UNION SELECT concat('US', lpad(CAST(o_orderkey * 7919 AS STRING), 10, '0')) FROM {orders}
UNION SELECT concat(lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), '-', lpad(CAST(o_orderkey * 31 % 10000 AS STRING), 4, '0')) FROM {orders}
UNION SELECT concat(CAST(c_custkey % 300 AS STRING), '.', CAST(c_custkey % 7 AS STRING), '.0.', CAST(c_custkey % 256 AS STRING)) FROM {customer}
UNION SELECT concat('10.0.', CAST(c_custkey % 256 AS STRING), '.0/', CAST(c_custkey % 40 AS STRING)) FROM {customer}
UNION SELECT md5(c_name) FROM {customer}
UNION SELECT concat('0x', substring(concat(md5(c_name), md5(c_name)), 1, 40)) FROM {customer}
UNION SELECT concat('#', substring(md5(c_name), 1, CAST(c_custkey % 9 AS INT))) FROM {customer}
UNION SELECT concat(substring(md5(c_name), 1, 8), '-', substring(md5(c_name), 9, 4), '-4', substring(md5(c_name), 14, 3), '-a', substring(md5(c_name), 18, 3), '-', substring(md5(c_name), 21, 12)) FROM {customer}
UNION SELECT concat(CAST(c_custkey % 30 AS STRING), ':', CAST(c_custkey % 70 AS STRING)) FROM {customer}
UNION SELECT concat(CAST(2000 + c_custkey % 30 AS STRING), '/', lpad(CAST(c_custkey % 15 AS STRING), 2, '0'), '/', lpad(CAST(c_custkey % 33 AS STRING), 2, '0')) FROM {customer}
UNION SELECT value FROM (VALUES (''), (' '), ('.'), ('-'), ('+1'), ('-007'), ('1e5'), ('e5'), ('.5'), ('1,5'), ('abc'), ('ABC'), ('Straße'), ('日本'), ('ｆｕｌｌ'), ('a-b_c'), ('a--b'), ('-a'),
  ('0xDEADBEEF'), ('0o17'), ('true'), ('False'), ('yes'), ('1'), ('0'), ('Pa55w0rd!'), ('P4$$word with space'), ('01ARZ3NDEKTSV4RRFFQ69G5FAV'), ('507f1f77bcf86cd799439011'),
  ('00000000-0000-0000-0000-000000000000'), ('FFFFFFFF-FFFF-FFFF-FFFF-FFFFFFFFFFFF'), ('1.2.3'), ('1.2.3-beta.1+build.5'), ('01.2.3'), ('a.b.c'), ('eyJ0.eyJz.SflK'), ('ab:cd:ef:01:23:45'), ('ab-cd-ef-01-23-45'),
  ('ab:cd:ef-01:23:45'), ('abcd.ef01.2345'), ('ab:cd:ef:01:23:45:67:89'), ('49015420-323751-8'), ('490154203237518'), ('4111 1111 1111 1111'), ('5500-0000-0000-0004'), ('340000000000009'), ('US0378331005'), ('AU0000XVGZA3'),
  ('978-3-16-148410-0'), ('0-306-40615-2'), ('080442957X'), ('0378-5955'), ('2434-561X'), ('2434-561x'), ('USRC17607839'), ('CSQU3054383'), ('DEUTDEFF500'), ('NEDSZAJJXXX'), ('::1'), ('2001:db8::ff00:42:8329'), ('1:2:3:4:5:6:7:8'),
  ('1::2::3'), ('::ffff:1.2.3.4'), ('fe80::1%eth0'), ('1:2:3'), (':1'), ('2001:db8::/32'), ('2001:db8::/129'), ('1.2.3.4/08'), ('example.com'), ('localhost'), ('-bad.com'), ('xn--froschgrn-x9a.com'), ('a.b.123'),
  ('magnet:?xt=urn:btih:06E2A9683BF4DA92C73A661AC56F0ECC9C63C5B4&dn=x'), ('text/html'), ('text/html; charset=utf-8'), ('multipart/form-data; boundary=x'), ('image/'), ('data:text/plain;base64,SGVsbG8='), ('data:,x'), ('data:text/plain'),
  ('rgb(1,2,3)'), ('rgb(1, 2, 3)'), ('rgba(255,255,255,0.5)'), ('rgb(5%,5%,100%)'), ('rgb(256,0,0)'), ('hsl(120,50%,50%)'), ('hsla(120deg 50% 50% / 0.5)'), ('hsl(120)'), ('(1.5, 2.5)'), ('90,-180'), ('91,0'), ('(1,2'), ('JBSWY3DP'),
  ('JBSWY3DPEE======'), ('91JPRV3F41BPYWKCCG'), ('Zm9vYmFy'), ('Zm9vYg=='), ('Zm9v-_'), ('2024-01-15T10:20:30Z'), ('2024-01-15 10:20:30.5+01:00'), ('2024-13-15T10:20:30Z'), ('12:59 PM'), ('13:00 PM'), ('23:59:59'), ('2024-02-29'), ('2023-02-29'),
  ('en-US'), ('de_DE'), ('zh-Hant-TW'), ('x-private'), ('e'), ('<a href=/x>&''"`\\</a>'), ('&lt;b&gt; &amp;amp;'), ('x=1&y=2&x=3'), ('?a=b+c&d=%41&e'), ('tab	x')) t(value)
"""
_TABLES = "pages events documents conversations part orders customer lineitem nation region supplier benchmark labels embeddings".split()


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLES}
    return spark.sql(SAMPLES.replace("('<a href=/x>&''\"`\\</a>')", "('<a href=/x>&\\'\"`\\\\</a>')").format(**places)).filter("value is not null")


_SAMPLES_SQL = "(SELECT value FROM (" + SAMPLES.format(**{t: t for t in _TABLES}) + ") WHERE value IS NOT NULL)"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rx(pattern: str, value: str = "value") -> str:
    return f"regexp_matches({value}, {_lit(pattern)})"


class _Later:
    """A module whose functions are called once a session runs; its constants are as they are."""

    def __init__(self, module):
        self.module = module

    def __getattr__(self, name: str):
        held = getattr(self.module, name)
        return (lambda *a, **b: lambda: held(*a, **b)) if callable(held) else held


V_, C_ = _Later(V), _Later(C)


def _family(name: str, columns: Callable[[], dict[str, tuple[Callable[[], Column], str | None]]]) -> None:
    """A query that applies functions to all samples, one column each; its SQL if every column has some."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return samples(spark, sf_dir).select("value", *[c().alias(n) for n, (c, _) in columns().items()])

    run.__name__ = name
    _QUERIES[name] = run
    _FAMILIES[name] = columns


_FAMILIES: dict[str, Callable] = {}


def _digit_sum(value: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"(ord(substring({value}, {i + 1}, 1)) - 48) * {w}" for i, w in enumerate(weights)) + ")"


def _luhn(value: str) -> str:
    digit = f"(ord(substring({value}, len({value}) - i::INT, 1)) - 48)"
    return f"(list_sum(list_transform(range(len({value})), lambda i: CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0)"


def _if(shape: str, check: str) -> str:
    return f"CASE WHEN {shape} THEN coalesce({check}, false) ELSE false END"


def _text() -> dict:
    return {
        "contains_the": (V_.contains("value", "the"), "contains(value, 'the')"),
        "contains_e_twice": (V_.contains("value", "E", True, 2), "len(string_split(lower(value), 'e')) > 2"),
        "equals_abc": (V_.equals("value", literal="abc"), "value = 'abc'"),
        "matches_vowels": (V_.matches("value", "[AEIOU]{2}", "i"), _rx("(?i)[AEIOU]{2}")),
        "alpha_en": (V_.is_alpha("value"), _rx("^[A-Za-z]+$")),
        "alpha_de": (V_.is_alpha("value", "de-DE", ignore=" -"), f"regexp_matches(regexp_replace(value, '[ -]', '', 'g'), {_lit('^[A-Za-zÄÖÜäöüß]+$')})"),
        "alphanumeric": (V_.is_alphanumeric("value"), _rx("^[0-9A-Za-z]+$")),
        "ascii": (V_.is_ascii("value"), _rx(r"^[\x00-\x7F]+$")),
        "full_width": (V_.is_full_width("value"), _rx(f"[^{V._HALF}]")),
        "half_width": (V_.is_half_width("value"), _rx(f"[{V._HALF}]")),
        "variable_width": (V_.is_variable_width("value"), f"{_rx(f'[^{V._HALF}]')} AND {_rx(f'[{V._HALF}]')}"),
        "multibyte": (V_.is_multibyte("value"), "strlen(value) > length(value)"),
        "surrogate_pair": (V_.is_surrogate_pair("value"), "false"),
        "lowercase": (V_.is_lowercase("value"), "value = lower(value)"),
        "uppercase": (lambda: F.when(F.col("value").contains("ß"), F.lit(False)).otherwise(V.is_uppercase("value")), "CASE WHEN contains(value, 'ß') THEN false ELSE value = upper(value) END"),
        "empty": (V_.is_empty("value"), "value = ''"),
        "blank": (V_.is_empty("value", True), r"NOT regexp_matches(value, '\S')"),
        "length_3_12": (V_.is_length("value", 3, 12), "length(value) BETWEEN 3 AND 12"),
        "byte_length_3_12": (V_.is_byte_length("value", 3, 12), "strlen(value) BETWEEN 3 AND 12"),
        "whitelisted": (V_.is_whitelisted("value", "abcdef0123456789"), _rx("^[abcdef0-9]*$")),
        "in_list": (V_.is_in("value", ["en", "de", "click"]), "value IN ('en', 'de', 'click')"),
        "in_text": (V_.is_in("value", "xclicky"), "contains('xclicky', value)"),
        "boolean": (V_.is_boolean("value"), "value IN ('true', 'false', '1', '0')"),
        "boolean_loose": (V_.is_boolean("value", True), "lower(value) IN ('true', 'false', '1', '0', 'yes', 'no')"),
        "slug": (V_.is_slug("value"), f"{_rx('^[a-z0-9]([a-z0-9_-]*[a-z0-9])?$')} AND NOT regexp_matches(substring(value, 2), '[-_][-_]')"),
        "strong_password": (V_.is_strong_password("value"), "length(value) >= 8 AND " + " AND ".join(_rx(p) for p in ("[a-z]", "[A-Z]", "[0-9]", V.SYMBOLS))),
        "password_score": (V_.password_score("value"), "len(list_distinct(string_split(value, '')))::DOUBLE * (value <> '')::INT + (length(value) - len(list_distinct(string_split(value, ''))) * (value <> '')::INT) * 0.5::DOUBLE" + "".join(f" + CASE WHEN {_rx(p)} THEN 10::DOUBLE ELSE 0::DOUBLE END" for p in ("[a-z]", "[A-Z]", "[0-9]", V.SYMBOLS))),
    }


#: By the parts of the number, not by one pattern: an exponent has digits, the rest is an optional sign, digits, point, digits.
_MANTISSA = "regexp_replace(string_split(lower(value), 'e')[1], '^[-+]', '')"
_FLOATING = (
    "(value NOT IN ('', '.', ',', '-', '+') AND len(string_split(lower(value), 'e')) <= 2 AND NOT contains(value, chr(10)) AND len(string_split(" + _MANTISSA + ", '.')) <= 2 AND translate(" + _MANTISSA + ", '0123456789.', '') = ''"
    " AND (len(string_split(lower(value), 'e')) = 1 OR (translate(regexp_replace(string_split(lower(value), 'e')[2], '^[-+]', ''), '0123456789', '') = '' AND regexp_replace(string_split(lower(value), 'e')[2], '^[-+]', '') <> '')))"
)


def _numbers() -> dict:
    n = "coalesce(TRY_CAST(value AS DECIMAL(38,0)), 99999999999999999999999999999999999999::DECIMAL(38,0))"
    whole = _rx("^[-+]?[0-9]+$")
    floating = _FLOATING
    head = r"TRY_CAST(nullif(regexp_extract(value, '^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE)"
    return {
        "int": (V_.is_int("value"), "translate(regexp_replace(value, '^[-+]', ''), '0123456789', '') = '' AND regexp_replace(value, '^[-+]', '') <> ''"),
        "int_plain": (V_.is_int("value", leading_zeroes=False), _rx("^[-+]?(0|[1-9][0-9]*)$")),
        "int_bounds": (V_.is_int("value", least=10, lt=5000), _if(whole, f"{n} >= 10 AND {n} < 5000")),
        "port": (V_.is_port("value"), _if(_rx("^[-+]?(0|[1-9][0-9]*)$"), f"{n} BETWEEN 0 AND 65535")),
        "float": (V_.is_float("value"), floating),
        "float_bounds": (V_.is_float("value", least=0.5, most=1e6), _if(floating, f"{head} >= 0.5 AND {head} <= 1e6")),
        "decimal": (V_.is_decimal("value"), f"{_rx('^[-+]?([0-9]+)?([.][0-9]+)?$')} AND replace(value, ' ', '') NOT IN ('', '-', '+')"),
        "decimal_comma": (V_.is_decimal("value", "de-DE"), f"{_rx('^[-+]?([0-9]+)?([,][0-9]+)?$')} AND replace(value, ' ', '') NOT IN ('', '-', '+')"),
        "numeric": (V_.is_numeric("value"), _rx(V.PATTERNS["numeric"])),
        "digits": (V_.is_numeric("value", True), _rx("^[0-9]+$")),
        "hexadecimal": (V_.is_hexadecimal("value"), "regexp_replace(lower(value), '^0[xh]', '') <> '' AND translate(regexp_replace(lower(value), '^0[xh]', ''), '0123456789abcdef', '') = ''"),
        "octal": (V_.is_octal("value"), "regexp_replace(lower(value), '^0o', '') <> '' AND translate(regexp_replace(lower(value), '^0o', ''), '01234567', '') = ''"),
        "divisible_by_7": (V_.is_divisible_by("value", 7), _if(floating, f"{head} % 7 = 0")),
    }


def _identifiers() -> dict:
    hexa = "[0-9a-fA-F]"
    macs = {n: " OR ".join([_rx(f"^{hexa}{{2}}({s}{hexa}{{2}}){{{n - 1}}}$") for s in (":", "-", r"\s")] + [_rx(rf"^({hexa}{{4}}\.){{{n // 2 - 1}}}{hexa}{{4}}$")]) for n in (6, 8)}
    return {
        "uuid": (V_.is_uuid("value"), f"{_rx(V.UUID_SHAPE % ('[1-8]', '[89AB]'))} OR lower(value) IN ('00000000-0000-0000-0000-000000000000', 'ffffffff-ffff-ffff-ffff-ffffffffffff')"),
        "uuid_4": (V_.is_uuid("value", 4), _rx(V.UUID_SHAPE % ("4", "[89AB]"))),
        "uuid_loose": (V_.is_uuid("value", "loose"), _rx("(?i)^[0-9A-F]{8}(-[0-9A-F]{4}){3}-[0-9A-F]{12}$")),
        "ulid": (V_.is_ulid("value"), _rx(V.PATTERNS["ulid"])),
        "mongo_id": (V_.is_mongo_id("value"), f"{_rx(V.PATTERNS['hexadecimal'])} AND length(value) = 24"),
        "hash_sha1": (V_.is_hash("value", "sha1"), _rx("^[a-fA-F0-9]{40}$")),
        "hash_unknown": (V_.is_hash("value", "none"), "false"),
        "md5": (V_.is_md5("value"), _rx("^[a-f0-9]{32}$")),
        "jwt": (V_.is_jwt("value"), "len(string_split(value, '.')) = 3 AND len(list_filter(string_split(value, '.'), lambda p: NOT regexp_matches(p, '^[A-Za-z0-9_-]*$'))) = 0"),
        "semver": (V_.is_semver("value"), _rx(V.PATTERNS["semver"])),
        "mac": (V_.is_mac_address("value"), f"{macs[6]} OR {macs[8]}"),
        "mac_bare": (V_.is_mac_address("value", "48", True), _rx("^[0-9a-fA-F]{12}$")),
        "ethereum": (V_.is_ethereum_address("value"), _rx(V.PATTERNS["ethereum"])),
        "btc": (V_.is_btc_address("value"), _rx(V.PATTERNS["btc"])),
        "isrc": (V_.is_isrc("value"), _rx(V.PATTERNS["isrc"])),
        "locale": (V_.is_locale("value"), " OR ".join(_rx(p) for p in (r"^([a-zA-Z]{2,3}(-[A-Za-z]{3}){0,3}|[a-zA-Z]{5,8})([-_][A-Za-z]{4})?([-_]([A-Za-z]{2}|[0-9]{3}))?([-_]([A-Za-z0-9]{5,8}|[0-9][A-Za-z0-9]{3}))*([-_][0-9A-WY-Za-wy-z](-[A-Za-z0-9]{2,8})+)*([-_]x(-[A-Za-z0-9]{1,8})+)?$", "^x(-[A-Za-z0-9]{1,8})+$"))),
    }


def _checksums() -> dict:
    bare = "regexp_replace(value, '[- ]+', '', 'g')"
    book = r"regexp_replace(value, '[\s-]+', '', 'g')"
    isin = "array_to_string(list_transform(string_split(value, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ord(c) - 55)::VARCHAR ELSE c END), '')"
    ten = _if(f"regexp_matches({book}, '^[0-9]{{9}}[0-9X]$')", f"({_digit_sum(book, list(range(1, 10)))} + CASE WHEN substring({book}, 10, 1) = 'X' THEN 100 ELSE (ord(substring({book}, 10, 1)) - 48) * 10 END) % 11 = 0")
    thirteen = _if(f"regexp_matches({book}, '^[0-9]{{13}}$')", f"{_digit_sum(book, [1, 3] * 6 + [1])} % 10 = 0")
    serial = "upper(replace(value, '-', ''))"
    letter = lambda i: f"(ord(substring(upper(value), {i + 1}, 1)) - 55)"
    box = " + ".join(f"({letter(i)} + {letter(i)} // 11) * {1 << i}" if i < 4 else f"(ord(substring(value, {i + 1}, 1)) - 48) * {1 << i}" for i in range(10))
    return {
        "luhn": (V_.is_luhn_number("value"), _if(f"regexp_matches({bare}, '^[0-9]+$')", _luhn(bare))),
        "imei": (V_.is_imei("value"), _if(_rx("^[0-9]{15}$"), _luhn("value"))),
        "imei_hyphens": (V_.is_imei("value", True), _if(_rx("^[0-9]{2}-[0-9]{6}-[0-9]{6}-[0-9]$"), _luhn("replace(value, '-', '')"))),
        "card": (V_.is_credit_card("value"), _if("(" + " OR ".join(f"regexp_matches({bare}, {_lit(p)})" for p in V.CARDS.values()) + f") AND regexp_matches({bare}, '^[0-9]+$')", _luhn(bare))),
        "card_visa": (V_.is_credit_card("value", "visa"), _if(f"regexp_matches({bare}, {_lit(V.CARDS['visa'])})", _luhn(bare))),
        "aba": (V_.is_aba_routing("value"), _if(f"{_rx('^[0-9]{9}$')} AND NOT {_rx('^(1[3-9]|20|3[3-9]|4[0-9]|5[0-9]|60|7[3-9]|8[1-9]|9[0-9])')}", f"{_digit_sum('value', [3, 7, 1] * 3)} % 10 = 0")),
        "isin": (V_.is_isin("value"), _if(_rx(V.PATTERNS["isin_shape"]), _luhn(isin))),
        "ean": (V_.is_ean("value"), " OR ".join("(" + _if(_rx(f"^[0-9]{{{n}}}$"), f"{_digit_sum('value', w)} % 10 = 0") + ")" for n, w in ((8, [3, 1] * 3 + [3, 1]), (13, [1, 3] * 6 + [1]), (14, [3, 1] * 7)))),
        "isbn": (V_.is_isbn("value"), f"({ten}) OR ({thirteen})"),
        "isbn_10": (V_.is_isbn("value", 10), ten),
        "issn": (V_.is_issn("value"), _if(_rx("(?i)^[0-9]{4}-?[0-9]{3}[0-9X]$"), f"({_digit_sum(serial, list(range(8, 1, -1)))} + CASE WHEN substring({serial}, 8, 1) = 'X' THEN 10 ELSE ord(substring({serial}, 8, 1)) - 48 END) % 11 = 0")),
        "container": (V_.is_iso6346("value"), _if("regexp_matches(upper(value), '^[A-Z]{3}[UJZ][0-9]{7}$')", f"({box}) % 11 % 10 = ord(substring(value, 11, 1)) - 48")),
    }


def _network() -> dict:
    four = _rx(f"^{V.IPV4}$")
    return {
        "ip4": (V_.is_ip("value", 4), four),
        "ip4_range": (V_.is_ip_range("value", 4), _if(f"len(string_split(value, '/')) = 2 AND regexp_matches(string_split(value, '/')[2], '^([0-9]|[1-9][0-9][0-9]?)$')", f"regexp_matches(string_split(value, '/')[1], {_lit(f'^{V.IPV4}$')}) AND TRY_CAST(string_split(value, '/')[2] AS INT) <= 32")),
        "magnet": (V_.is_magnet_uri("value"), f"starts_with(value, 'magnet:?') AND {_rx(V.PATTERNS['magnet'])}"),
        "mime": (V_.is_mime_type("value"), " OR ".join(_rx(p) for p in (V.PATTERNS["mime"], r'(?i)^text/[a-z0-9.+-]{1,100};\s?charset=("[a-z0-9.+\s-]{0,70}"|[a-z0-9.+-]{0,70})(\s?\([a-z0-9.+\s-]{1,20}\))?$', r'(?i)^multipart/[a-z0-9.+-]{1,100}(;\s?(boundary|charset)=("[a-z0-9.+\s-]{0,70}"|[a-z0-9.+-]{0,70})(\s?\([a-z0-9.+\s-]{1,20}\))?){0,2}$'))),
        "data_uri": (V_.is_data_uri("value"), _rx(r"^data:([a-zA-Z]+/[a-zA-Z0-9+._-]+)?(;[a-zA-Z-]+=[a-zA-Z0-9-]+)*(;[bB][aA][sS][eE]64)?,[a-zA-Z0-9!$&'()*+,;=\-._~:@/?%\s]*$")),
    }


def _formats() -> dict:
    share = "([0-9]|[1-9][0-9]|100)%"
    alpha = r"(0?\.[0-9]+|1(\.0+)?|0(\.0+)?)"
    o = V._OCTET
    rgb = [rf"^rgb\({o},{o},{o}\)$", rf"^rgba\(({o},){{3}}{alpha}\)$", rf"^rgb\({share},{share},{share}\)$", rf"^rgba\(({share},){{3}}{alpha}\)$"]
    return {
        "hex_color": (V_.is_hex_color("value"), _rx(V.PATTERNS["hex_color"])),
        "hex_color_hash": (V_.is_hex_color("value", True), f"{_rx(V.PATTERNS['hex_color'])} AND starts_with(value, '#')"),
        "rgb": (V_.is_rgb_color("value"), " OR ".join(_rx(p) for p in rgb)),
        "rgb_spaces": (V_.is_rgb_color("value", True, False), f"starts_with(value, 'rgb') AND ({' OR '.join(_rx(p, _SPACELESS) for p in rgb[:2])})"),
        "base32": (V_.is_base32("value"), f"{_rx(V.PATTERNS['base32'])} AND length(value) % 8 = 0"),
        "base32_crockford": (V_.is_base32("value", True), _rx(V.PATTERNS["crockford"])),
        "base58": (V_.is_base58("value"), _rx(V.PATTERNS["base58"])),
        "base64": (V_.is_base64("value"), f"value = '' OR (length(value) % 4 = 0 AND {_rx('^[A-Za-z0-9+/]+={0,2}$')})"),
        "base64_url": (V_.is_base64("value", True), f"value = '' OR {_rx('^[A-Za-z0-9_-]+$')}"),
        "rfc3339": (V_.is_rfc3339("value"), _rx(V.PATTERNS["rfc3339"])),
        "time_24": (V_.is_time("value"), _rx(V.TIMES["hour24", "default"])),
        "time_12": (V_.is_time("value", "hour12", "withOptionalSeconds"), _rx(V.TIMES["hour12", "withOptionalSeconds"])),
        "date_ymd": (V_.is_date("value"), f"({_rx('^[0-9]{4}/[0-9]{2}/[0-9]{2}$')} OR {_rx('^[0-9]{4}-[0-9]{2}-[0-9]{2}$')}) AND TRY_CAST(replace(value, '/', '-') AS DATE) IS NOT NULL"),
    }


_SPACELESS = r"regexp_replace(value, '\s', '', 'g')"


def _more() -> dict:
    return {
        "ip": (V_.is_ip("value"), None), "ip6": (V_.is_ip("value", 6), None), "ip_range": (V_.is_ip_range("value"), None), "fqdn": (V_.is_fqdn("value"), None),
        "hsl": (V_.is_hsl("value"), None), "lat_long": (V_.is_lat_long("value"), None), "bic": (V_.is_bic("value", ["DE", "US", "NL", "ZA"]), None),
    }


def _converters() -> dict:
    esc, une = "value", "value"
    for c, r in C.REFERENCES:
        esc = f"replace({esc}, {_lit(c)}, {_lit(r)})"
    for c, r in (*C.REFERENCES[1:], C.REFERENCES[0]):
        une = f"replace({une}, {_lit(r)}, {_lit(c)})"
    floating = _FLOATING
    head = r"TRY_CAST(nullif(regexp_extract(value, '^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE)"
    return {
        "blacklist": (C_.blacklist("value", "aeiou"), "regexp_replace(value, '[aeiou]+', '', 'g')"),
        "whitelist": (C_.whitelist("value", "a-z"), "regexp_replace(value, '[^a-z]+', '', 'g')"),
        "strip_low": (C_.strip_low("value"), r"regexp_replace(value, '[\x00-\x1F\x7F]+', '', 'g')"),
        "ltrim_chars": (C_.ltrim("value", "0-"), "regexp_replace(value, '^[0-]+', '')"),
        "rtrim_chars": (C_.rtrim("value", "./"), r"regexp_replace(value, '[./]+(\n?)$', '\1')"),
        "trim": (C_.trim("value"), r"regexp_replace(regexp_replace(value, '^\s+', ''), '\s+$', '')"),
        "escaped": (C_.escape("value"), esc),
        "unescaped": (C_.unescape("value"), une),
        "as_boolean": (C_.to_boolean("value"), "NOT (value IN ('0', '') OR lower(value) = 'false')"),
        "as_boolean_strict": (C_.to_boolean("value", True), "value = '1' OR lower(value) = 'true'"),
        "as_int": (C_.to_int("value"), r"TRY_CAST(nullif(regexp_extract(regexp_replace(value, '^\s+', ''), '^([+-]?[0-9]+)', 1), '') AS BIGINT)"),
        "as_float_or_zero": (lambda: F.nanvl(C.to_float("value"), F.lit(0.0)), f"CASE WHEN {floating} THEN coalesce({head}, 0::DOUBLE) ELSE 0::DOUBLE END"),
        "as_string": (C_.to_string("value"), "value"),
    }


for _name, _columns in (("validate_text", _text), ("validate_numbers", _numbers), ("validate_identifiers", _identifiers), ("validate_checksums", _checksums), ("validate_network", _network), ("validate_formats", _formats), ("validate_more", _more), ("convert_strings", _converters)):
    _family(_name, _columns)


# -- addresses and query strings ----------------------------------------------------


@query(r"SELECT page_id, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, k::INTEGER AS place, string_split(p, '=')[1] AS key, regexp_extract(p, '^[^=]*=(.*)$', 1) AS value FROM (SELECT page_id, url, unnest(range(len(ps))) AS k, unnest(ps) AS p FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '') AS ps FROM pages))")
def qs_flat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", Q.query_part("url").alias("query"))
    return pages.select("page_id", "query", F.posexplode(Q.pairs("query")).alias("place", "pair")).select("page_id", "query", "place", "pair.key", "pair.value")


@query(r"SELECT string_split(p, '=')[1] AS key, regexp_extract(p, '^[^=]*=(.*)$', 1) AS value, count(*) AS pages FROM (SELECT unnest(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '')) AS p FROM pages) GROUP BY 1, 2")
def qs_param_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "pages").select(F.explode(Q.parse_flat(Q.query_part("url"))).alias("key", "values"))
    return own.select("key", F.explode("values").alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("pages"))


@query(r"SELECT page_id, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS again FROM pages")
def qs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", Q.stringify_flat(Q.parse_flat(Q.query_part("url"))).alias("again"))


_HOST = r"^https?://([^/?#:]+)"


@query(rf"SELECT regexp_extract(url, '{_HOST}', 1) AS host, count(*) AS pages, count(*) FILTER (contains(url, '?')) AS with_query, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")
def url_host_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", _HOST, 1))
    return pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("url").contains("?")).alias("with_query"), F.sum(F.length("html")).cast("long").alias("chars"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, (len(string_split(html, '<a ')) - 1)::INTEGER AS links, (len(string_split(html, '<p>')) - 1)::INTEGER AS paragraphs, strlen(html)::INTEGER AS bytes FROM pages")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda tag: F.regexp_count("html", F.lit(tag))
    return _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), count("<a ").alias("links"), count("<p>").alias("paragraphs"), F.octet_length("html").alias("bytes"))


@query(r"SELECT lang, host_ok, count(*) AS pages, rank() OVER (PARTITION BY lang ORDER BY count(*) DESC)::INTEGER AS place FROM (SELECT regexp_extract(url, '^https?://[^/]+/([a-z]{2})(/|$)', 1) AS lang, regexp_matches(url, '^https?://[a-z0-9.-]+\.(com|org|net)/') AS host_ok FROM pages) GROUP BY 1, 2")
def pages_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    pages = _read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})(/|$)", 1).alias("lang"), F.col("url").rlike(r"^https?://[a-z0-9.-]+\.(com|org|net)/").alias("host_ok"))
    counted = pages.groupBy("lang", "host_ok").agg(F.count(F.lit(1)).alias("pages"))
    return counted.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.col("pages").desc())))


@query("SELECT lang, source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY CUBE (lang, source)")
def document_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").cast("long").alias("chars"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Z]'))::INTEGER AS upper, len(regexp_extract_all(text, '[a-z]'))::INTEGER AS lower, len(regexp_extract_all(text, '[0-9]'))::INTEGER AS digits, (length(text) - length(replace(text, ',', '')))::INTEGER AS commas FROM documents")
def char_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c, n: F.regexp_count("text", F.lit(c)).alias(n)
    return _read(spark, sf_dir, "documents").select("doc_id", count("[A-Z]", "upper"), count("[a-z]", "lower"), count("[0-9]", "digits"), count(",", "commas"))


# -- graphs -------------------------------------------------------------------------


def _customers(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and their orders' halves as a graph for each segment: customer k points to k // 2."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("graph_id"), F.col("c_custkey").alias("v"))
    ends = c.select("graph_id", "v", F.floor(F.col("v") / 2).alias("w"))
    edges = ends.join(c.withColumnRenamed("v", "w"), ["graph_id", "w"], "left_semi").filter("v <> w").select("graph_id", "v", "w").withColumn("name", F.lit(None).cast("string"))
    return Graph(c.withColumn("parent", F.lit(None).cast("long")), edges)


_GRAPH = "WITH RECURSIVE n AS (SELECT c_mktsegment AS graph_id, c_custkey AS v FROM customer), e AS (SELECT a.graph_id, a.v, b.v AS w FROM n a JOIN n b ON a.graph_id = b.graph_id AND b.v = a.v // 2 AND a.v <> b.v) "


@query(_GRAPH + "SELECT n.graph_id, count(DISTINCT n.v) AS node_count, (SELECT count(*) FROM e WHERE e.graph_id = n.graph_id) AS edge_count FROM n GROUP BY n.graph_id")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).counts()


@query(_GRAPH + "SELECT graph_id, v FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = n.graph_id AND e.w = n.v)")
def graph_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).sources()


@query(_GRAPH + "SELECT graph_id, v FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = n.graph_id AND e.v = n.v)")
def graph_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).sinks()


@query(_GRAPH + "SELECT graph_id, v, w AS neighbor FROM e UNION SELECT graph_id, w, v FROM e")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).neighbors()


@query(_GRAPH + "SELECT graph_id, v, (SELECT count(*) FROM e WHERE e.graph_id = n.graph_id AND e.w = n.v) AS in_degree, (SELECT count(*) FROM e WHERE e.graph_id = n.graph_id AND e.v = n.v) AS out_degree FROM n")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).degrees()


@query(_GRAPH + "SELECT graph_id, v, w FROM e WHERE v % 3 <> 0 AND w % 3 <> 0")
def graph_filter_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).filter_nodes("v % 3 <> 0").edges.select("graph_id", "v", "w")


@query(_GRAPH + "SELECT graph_id, v, w FROM e WHERE v % 5 <> 0 AND w % 5 <> 0")
def graph_remove_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _customers(spark, sf_dir)
    return g.remove_nodes(g.nodes.filter("v % 5 = 0")).edges.select("graph_id", "v", "w")


@query(_GRAPH + ", up(graph_id, v, top) AS (SELECT graph_id, v, v FROM n UNION ALL SELECT up.graph_id, up.v, e.w FROM up JOIN e ON e.graph_id = up.graph_id AND e.v = up.top) SELECT graph_id, v, min(top) AS component FROM up GROUP BY graph_id, v")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return _customers(spark, sf_dir).components()


@query(_GRAPH + ", up(graph_id, v, top, d) AS (SELECT graph_id, v, v, 0 FROM n UNION ALL SELECT up.graph_id, up.v, e.w, up.d - 1 FROM up JOIN e ON e.graph_id = up.graph_id AND e.v = up.top) SELECT graph_id, v, min(d)::BIGINT AS rank FROM up GROUP BY graph_id, v")
def graph_longest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return _customers(spark, sf_dir).longest_path_ranks()


@query("WITH e AS (SELECT c_mktsegment AS g, c_custkey AS v, c_custkey * 7919 % 1009 AS w, c_custkey % 3 + 1 AS k FROM customer) SELECT a.g AS graph_id, sum(a.k * b.k)::BIGINT AS crossings FROM e a JOIN e b ON a.g = b.g AND a.v < b.v AND a.w > b.w GROUP BY a.g")
def graph_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in order of their keys above, 1009 places below, an edge from each, of weight 1 to 3."""
    own = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("graph_id"), F.col("c_custkey").alias("v"), (F.col("c_custkey") * 7919 % 1009).alias("pos"), (F.col("c_custkey") % 3 + 1).alias("weight"))
    edges = own.select("graph_id", F.concat(F.lit("u"), "v").alias("v"), F.concat(F.lit("l"), "pos").alias("w"), "weight", F.lit(None).cast("string").alias("name"))
    upper = own.select("graph_id", F.concat(F.lit("u"), "v").alias("v"), F.lit(0).alias("layer"), F.col("v").alias("pos"))
    lower = own.select("graph_id", F.concat(F.lit("l"), "pos").alias("v"), F.lit(1).alias("layer"), "pos").distinct()
    order = upper.unionByName(lower)
    return Graph(order.select("graph_id", "v"), edges).crossings(order)


_COUNTED = "a article body br div footer h1 head html li meta nav p script style title ul".split()
_OUTSIDE = "regexp_replace(html, '<!--.*?-->|(<script[^>]*>).*?</script>', '\\1', 'gs')"


@query(" UNION ALL ".join(f"SELECT page_id, '{t}' AS name, len(regexp_extract_all({_OUTSIDE}, '<{t}[ >/]'))::BIGINT AS n FROM pages WHERE len(regexp_extract_all({_OUTSIDE}, '<{t}[ >/]')) > 0" for t in _COUNTED))
def html_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.node_table(_read(spark, sf_dir, "pages"), "html", "page_id").filter(F.col("name").isin(_COUNTED))
    return rows.groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query()
def validate_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {"is_url": A.is_url("value"), "is_email": A.is_email("value"), "is_json": A.is_json("value"), "is_iso8601": A.is_iso8601("value"), "is_iso8601_strict": A.is_iso8601("value", strict=True)}
    return samples(spark, sf_dir).select("value", *[c.alias(n) for n, c in own.items()])


@query("SELECT event_id, ts > TIMESTAMP '2024-01-15' AS is_after, ts < TIMESTAMP '2024-01-15' AS is_before FROM events")
def validate_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return _read(spark, sf_dir, "events").select("event_id", A.is_after(at, "2024-01-15").alias("is_after"), A.is_before(at, "2024-01-15").alias("is_before"))


@query("SELECT event_id, json_valid(props) AND json_type(props) IN ('OBJECT', 'ARRAY') AS is_json FROM events")
def validate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", A.is_json("props").alias("is_json"))


@query()
def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.node_table(_read(spark, sf_dir, "pages"), "html", "page_id")
    return rows.withColumn("attrs", F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " "))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", H.text("html").alias("text"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", H.markdown("html", remove=("head", "script", "style"), gfm=True).alias("markdown"))


@query()
def sanitize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", H.sanitized("html").alias("html"))


@query()
def qs_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", H.query_json(Q.query_part("url")).alias("query"))


def _checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names; only where it names none, as in tests, to a local one."""
    ctx = spark.sparkContext
    if not ctx._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not ctx.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        ctx.setCheckpointDir(at or tempfile.mkdtemp(prefix="docloom-"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from docloom import diagram_queries, more_queries  # noqa: F401  (register their queries here)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    out = {k: v for k, v in _SQL.items() if v}
    for name, columns in _FAMILIES.items():
        own = columns()
        if all(sql for _, sql in own.values()):
            out[name] = "SELECT value, " + ", ".join(f"({sql}) AS {n}" for n, (_, sql) in own.items()) + f" FROM {_SAMPLES_SQL}"
    return out
