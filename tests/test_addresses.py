from docloom.functions import addresses as A


def check(spark, f, good, bad, **options):
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "v string")
    got = {r.v: r.ok for r in df.select("v", f("v", **options).alias("ok")).collect()}
    assert [x for x in good if not got[x]] == []
    assert [x for x in bad if got[x]] == []
    assert spark.createDataFrame([(None,)], "v string").select(f("v", **options).alias("ok")).collect()[0].ok is None


def test_url(spark):
    good = ["foobar.com", "http://a.com:23/", "https://u:p@a.com/x?y=1#z", "ftp://a.museum", "http://127.0.0.1:8/", "a.com:80/x", "http://[::1]:80/", "user@a.com", "http://u%20@a.com", "http:a.com", "HTTP://A.com", "http://a.com:"]
    bad = ["", "http://", "xyz://a.com", "//a.com", "http://a.com:0", "http://a.com:65536", "http://a.com:x", "mailto:a@b.com", "http://a b.com", "a", "http://@a.com", "http://:@a.com", "http://u:p:q@a.com", "javascript:x", "http://<a>.com", "http://a.com:99999999999999999999"]
    check(spark, A.is_url, good, bad)
    check(spark, A.is_url, ["http://a.com"], ["a.com", "a.com:80"], require_protocol=True)
    check(spark, A.is_url, ["http://a.com:80"], ["http://a.com"], require_port=True)
    check(spark, A.is_url, ["http://A.com"], ["http://b.com"], hosts=("a.com",))
    check(spark, A.is_url, ["http://localhost", "//localhost"], ["http://a_b.com"], require_tld=False, allow_protocol_relative=True)


def test_email(spark):
    good = ["foo@bar.com", "x@x.au", "a.b+c@d.co.uk", "hans@mäller.com", "tëst@x.com", '"a b"@c.com', '"a\\"b"@c.com']
    bad = ["", "a", "@b.com", "a@", "a@b", "a..b@c.com", ".a@c.com", "a b@c.com", '"a"b"@c.com', "a@b@c.com", "x" * 65 + "@a.com", "a@b.c\n"]
    check(spark, A.is_email, good, bad)
    check(spark, A.is_email, ["a@b.com"], ["tëst@x.com"], utf8=False)
    check(spark, A.is_email, ["N <a@b.com>", '"N. N." <a@b.com>'], ["a@b.com", "N. <a@b.com>", " <a@b.com>"], display_name="require")
    check(spark, A.is_email, ["a@[127.0.0.1]", "a@127.0.0.1"], ["a@[x]"], ip_domain=True)
    check(spark, A.is_email, ["a@b.com"], ["a@c.com"], not_hosts=("c.com",))


def test_json(spark):
    check(spark, A.is_json, ['{"a": 1}', "[]", ' {"b": [null, "x"]} '], ["", "1", "null", "{", "{'a': 1}", "[1] x", "[1],[2]", "[1]] [", "a"])
    check(spark, A.is_json, ["1", "null", '"x"', "{}"], ["x", ""], primitives=True)


def test_iso8601(spark):
    good = ["2009", "2009-12", "2009-05-19", "20090519", "2009123", "2009-123", "2009-W21-2T01:22", "2009W511", "2009-05-19 14:39:22+0600", "2009-05-19T14:39Z", "2007-04-06T00:00", "2010-02-18T16:23.33+0600", "2010-02-18T16.23334444", "2009-05-19T24:00", "20160201T153000Z", "-0010-01-01"]
    bad = ["200905", "2009367", "2009-", "2007-04-05T24:50", "2009-000", "2009-M511", "200912-01", "2009-05-1914:39", "2009-05-19r14:39", "20090519T14:39:22:1", "2010-02-18T16:23:48,444:00", "", "x"]
    check(spark, A.is_iso8601, good, bad)
    check(spark, A.is_iso8601, ["2000-02-29", "2009-123", "2020-366"], ["2009-02-29", "2010-02-30", "2009-366"], strict=True)
    check(spark, A.is_iso8601, ["2009-05-19T14:39"], ["2009-05-19 14:39"], strict_separator=True)


def test_moments(spark):
    check(spark, A.is_after, ["2024-01-02", "2024-01-01T00:00:01"], ["2024-01-01", "2023-12-31", "x", ""], moment="2024-01-01")
    check(spark, A.is_before, ["2023-12-31"], ["2024-01-01", "2024-01-02", "x"], moment="2024-01-01")
