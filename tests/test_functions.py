import pytest
from pyspark.sql import functions as F

from docloom.functions import convert as C
from docloom.functions import urlquery as Q
from docloom.functions import validate as V


def ask(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string").select("i", column.alias("x")).collect()
    return [r.x for r in sorted(rows)]


CASES = [
    ("is_int", {}, ["13", "-0", "+1", "007"], ["", "1.0", "a", " 1"]),
    ("is_int", {"leading_zeroes": False}, ["0", "10"], ["007"]),
    ("is_port", {}, ["0", "65535"], ["65536", "-1", "080"]),
    ("is_float", {}, ["1.5", "-.5", "1e5", "e5", "1.", "1E-5"], ["", ".", "a", "1,5", "e", "-e", "1e", "5e+"]),
    ("is_uuid", {}, ["9c858901-8a57-4791-81fe-4c455b099bc9", "00000000-0000-0000-0000-000000000000"], ["", "9c858901-8a57-0791-81fe-4c455b099bc9"]),
    ("is_luhn_number", {}, ["4111 1111-1111 1111", "0"], ["4111111111111112", "", "a"]),
    ("is_credit_card", {}, ["4111111111111111", "375556917985515"], ["5398228707871528"]),
    ("is_isin", {}, ["US0378331005", "AU0000XVGZA3"], ["US0378331004", "us0378331005"]),
    ("is_isbn", {}, ["978-3-16-148410-0", "0-306-40615-2", "080442957X"], ["080442957x", "9783161484101"]),
    ("is_issn", {}, ["0378-5955", "2434561X"], ["0378-5954"]),
    ("is_ean", {}, ["73513537", "4012345678901"], ["73513536", "1"]),
    ("is_imei", {}, ["490154203237518"], ["490154203237517", "49-015420-323751-8"]),
    ("is_iso6346", {}, ["CSQU3054383", "csqu3054383"], ["CSQU3054384"]),
    ("is_aba_routing", {}, ["322070381", "011075150"], ["426317976", "789456124"]),
    ("is_mac_address", {}, ["ab:cd:ef:01:23:45", "abcd.ef01.2345", "ab cd ef 01 23 45"], ["ab:cd:ef-01:23:45", "abcdef012345"]),
    ("is_ip", {}, ["127.0.0.1", "::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "fe80::1%eth0", "::"], ["256.0.0.1", "1::2::3", "1:2", ":1", "12345::", "1.2.3"]),
    ("is_ip_range", {}, ["10.0.0.0/8", "::1/128"], ["10.0.0.0/33", "10.0.0.0/08", "10.0.0.0"]),
    ("is_fqdn", {}, ["example.com", "xn--froschgrn-x9a.com"], ["localhost", "-a.com", "a.com.", "a_b.com"]),
    ("is_slug", {}, ["foo", "foo-bar_1"], ["foo--bar", "-foo", "Foo"]),
    ("is_base64", {}, ["", "Zm9vYg=="], ["Zm9vYg", "12345"]),
    ("is_rgb_color", {}, ["rgb(0,31,255)", "rgba(1,1,1,.5)", "rgb(5%,5%,100%)"], ["rgb(0,0,256)", "rgb(1, 2, 3)"]),
    ("is_hsl", {}, ["hsl(360,0%,100%)", "hsl(200 0% 0% / 1%)"], ["hsl(360)", "hsl(1,2,3)"]),
    ("is_lat_long", {}, ["(-17.738223, 85.605469)", "90,-180"], ["91,0", "(1,2", "1"]),
    ("is_date", {}, ["2024/02/29", "2024-01-05"], ["2023/02/29", "24-01-05", "2024/1/5", "2024/01-05"]),
    ("is_locale", {}, ["en", "zh-Hant-TW", "de_DE"], ["e", "en-"]),
    ("is_data_uri", {}, ["data:text/plain;base64,SGVsbG8=", "data:,x"], ["data:text/plain", "text,x"]),
    ("is_strong_password", {}, ["%2%k{7BsL\"M%Kd6e"], ["password", "hunter2"]),
]


@pytest.mark.parametrize("name,options,good,bad", CASES, ids=lambda x: x if isinstance(x, str) else None)
def test_predicates(spark, name, options, good, bad):
    column = getattr(V, name)("value", **options)
    assert ask(spark, column, [*good, *bad, None]) == [True] * len(good) + [False] * len(bad) + [None]


def test_converters(spark):
    assert ask(spark, C.unescape(C.escape("value")), ["<a href='/x'>&\"`\\", None]) == ["<a href='/x'>&\"`\\", None]
    assert ask(spark, C.to_int("value", 16), ["0xff", "-1g", "z"]) == [255, -1, None]
    assert ask(spark, C.to_boolean("value"), ["False", "0", "", "no"]) == [False, False, False, True]
    assert ask(spark, C.trim("value"), ["\t a  "]) == ["a"]


def test_query_strings(spark):
    got = ask(spark, Q.parse_flat("value"), ["a=b+c&d=%41&a=2&e", "", "x=%zz&y=1=2"])
    assert got == [{"a": ["b c", "2"], "d": ["A"], "e": [""]}, {}, {"x": ["%zz"], "y": ["1=2"]}]
    assert ask(spark, Q.stringify_flat(F.create_map(F.lit("a b"), F.array("value", F.lit("~"))),), ["é&"]) == ["a%20b=%C3%A9%26&a%20b=~"]
