import pytest
from pyspark.sql import functions as F

from tracewell.functions import urls
from tracewell.operators import domains, links


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, found",
    [
        ("see https://a.com/x, and www.b.org.", ["https://a.com/x,", "www.b.org."]),
        ("HTTP://A.com", []),
        ("a (http://x.y) [www.z.w]", ["http://x.y", "www.z.w"]),
        ("http://a.b c", ["http://a.b"]),
        ("", []),
        (None, []),
    ],
)
def test_find(spark, text, found):
    assert one(spark, text, urls.find_urls) == found


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("http://a.com.", "http://a.com"),
        ("http://a.com.‎", "http://a.com."),  # the mark goes after the dot was looked for
        ("http://a.com，rest", "http://a.com"),
        ("http://a.com/ä", "http://a.com/"),
        ("http://a.*", None),
        ("äwww", None),
        (None, None),
    ],
)
def test_clean(spark, raw, clean):
    assert one(spark, raw, urls.clean_url) == clean


@pytest.mark.parametrize("url, ok", [("www.a.com", True), ("http://localhost:80/x", True), ("http://1.2.3.4", True), ("http://-a.com", False), ("http://a", False), ("http://a.com:123456", False), (None, False)])
def test_valid(spark, url, ok):
    assert one(spark, url, urls.is_valid_url) is ok


@pytest.mark.parametrize(
    "url, net, domain",
    [
        ("http://u:p@A.B.com:8080/x", "u:p@a.b.com:8080", "b.com"),
        ("www.foo.co.uk/a", "www.foo.co.uk", "co.uk"),
        ("http://127.0.0.1:80/", "127.0.0.1:80", "127.0.0.1"),
        ("http://foo_bar.com/x y", "foo_bar.com", "foo_bar.com"),
        ("mailto:a@b.co", "mailto:a@b.co", "b.co"),
        ("foo.com:80/p", "foo.com:80", "foo.com"),
        ("http://[::1]/", "[::1]", "["),
        ("  ", None, ""),
        (None, None, ""),
    ],
)
def test_hosts(spark, url, net, domain):
    assert one(spark, url, urls.netloc) == net
    assert one(spark, url, lambda c: urls.registered_domain(urls.normalise_url(c))) == domain


def test_legacy_scheme(spark):
    assert one(spark, "", lambda c: urls.normalise_url(c, "legacy")) == "http://"
    assert one(spark, "a.com", lambda c: urls.normalise_url(c, "legacy")) == "a.com"
    with pytest.raises(ValueError):
        urls.normalise_url(F.lit("x"), "other")


def test_first_message_wins(spark):
    rows = [(2, "www.a.com", "late"), (1, "x www.b.com www.a.com. www.a.com", "early"), (3, None, None)]
    df = spark.createDataFrame(rows, "msg_id int, message string, url0 string")
    out = {r.url: (r.msg_id, r.pos) for r in links.extract_urls(df, "message", "msg_id").collect()}
    assert out == {"www.a.com": (1, 1), "www.b.com": (1, 0)}
    stats = links.extraction_stats(df, "message").first()
    assert (stats.messages_with_url, stats.valid_urls, stats.distinct_urls) == (2, 4, 2)


GOLDEN = {"t.me": (65089, 72.69), "viber.com": (4409, 4.92), "bit.ly": (1618, 1.81), "tinyurl.com": (831, 0.93), "r-kioski.fi": (672, 0.75), "repli.rs": (565, 0.63), "cred.ee": (552, 0.62), "smsb.co": (326, 0.36), "page.link": (289, 0.32), "ptlk.me": (259, 0.29)}


def test_top_n_golden(spark):
    counts = [(d, n) for d, (n, _) in GOLDEN.items()] + [(f"x{i}.ee", 200) for i in range(74)] + [("y.ee", 139), ("", 500)]
    df = spark.createDataFrame(counts, "domain string, n int").select("domain", F.explode(F.sequence(F.lit(1), "n")))
    out = {r.domain: (r["count"], r.percentage) for r in domains.top_n_with_others(df, "domain").collect()}
    assert out == {**GOLDEN, "Others": (14939, 16.68)}


def test_top_n_edges(spark):
    empty = spark.createDataFrame([], "domain string")
    assert domains.top_n_with_others(empty, "domain").count() == 0
    few = spark.createDataFrame([("b",), ("a",), (None,)], "domain string")
    assert [tuple(r) for r in domains.top_n_with_others(few, "domain", 2).orderBy("domain").collect()] == [("a", 1, 50.0), ("b", 1, 50.0)]


def test_ranks_keep_all_rows(spark):
    ranks = domains.rank_table(spark.createDataFrame([(1, "A.com", 0), (9, "a.com", 1)], "r int, d string, o int"), "r", "d", "o")
    rows = spark.createDataFrame([("http://a.com/x",), ("http://b.com",), (None,), ("",)], "url string")
    out = domains.with_rank(rows, "url", ranks)
    assert {(r.url, r.tranco_rank) for r in out.collect()} == {("http://a.com/x", 9), ("http://b.com", None), (None, None), ("", None)}


def test_three_way_semi_join(spark):
    files = spark.createDataFrame([("abc.png",), ("d",)], "name string")
    rows = [(1, "abc"), (2, "abc.png"), (3, "abc.jpg"), (4, " abc "), (5, ""), (6, None), (7, "x"), (8, "d"), (8, "d")]
    out = domains.keep_surviving(spark.createDataFrame(rows, "seq int, hash string"), files, "seq")
    assert sorted(r.seq for r in out.collect()) == [1, 2, 3, 4, 8, 8]


def test_longest_suffix(spark):
    rows = spark.createDataFrame([("http://a.b.co.uk/",), ("x.y.com",), ("z.zz",)], "url string")
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("com",)], "suffix string")
    assert {tuple(r) for r in domains.suffix_domain(rows, "url", suffixes).collect()} == {("http://a.b.co.uk/", "b.co.uk"), ("x.y.com", "y.com"), ("z.zz", "z.zz")}
