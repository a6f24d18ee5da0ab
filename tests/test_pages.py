import base64
import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import body, webjson
from tracewell.operators import harvest


@pytest.mark.parametrize(
    "text, encoding, mime, out",
    [
        (None, None, None, ""), ("", "base64", None, ""), ("aG*k=", "BASE64", None, "hi"), ("abc", "base64", None, "abc"), ("aGk=", None, None, "aGk="),
        (base64.b64encode("ä".encode("latin-1")).decode(), " Base64 ", 'text/html; charset="ISO-8859-1"', "ä"), (base64.b64encode(b"\xff").decode(), "base64", "text/html", "�"),
        (base64.b64encode("ä".encode()).decode(), "base64", "text/html;charset=nonsense", "ä"), (base64.b64encode(b"ab").decode(), "base64", "x; charset=hex", "ab"), ("ä", "base64", None, "ä"),
    ],
)
def test_body(spark, text, encoding, mime, out):
    assert body.decode_body(text, encoding, mime) == out
    df = spark.createDataFrame([(text, encoding, mime)], "t string, e string, m string")
    assert df.select(body.body(F.col("t"), F.col("e"), F.col("m"))).first()[0] == out


def test_headers_and_types(spark):
    df = spark.createDataFrame([([("A", "1"), ("a", "2"), ("", "x"), (None, "y"), ("Content-Type", "T/H; Charset='X'")],), ([],)], "h array<struct<name:string,value:string>>")
    rows = df.select(webjson.header_map(F.col("h")).alias("m"))
    first, second = rows.select("m", webjson.content_type(F.lit(""), F.col("m")).alias("c")).collect()
    assert first.m == {"a": "2", "content-type": "T/H; Charset='X'"} and first.c == "t/h; charset='x'"
    assert second.m == {} and second.c == ""
    assert spark.range(1).select(webjson.charset(F.lit("text/html; a=b; charset=\"utf-8\" ; charset=x"))).first()[0] == "utf-8"


def test_canonical():
    assert webjson.canonical('{"a":1,"a":2,"b":1.0,"c":NaN,"d":1e2}') == '{"a":2,"b":1.0,"c":NaN,"d":100.0}'
    assert webjson.canonical('{"b":"ä", "a":[1, 2]}') == '{"a":[1,2],"b":"ä"}'
    assert webjson.canonical("{} x") is None and webjson.canonical(None) is None and webjson.canonical("") is None


def test_scripts_and_literals():
    html = """<script type="application/ld+json">//<![CDATA[
{"a": 1}
//]]></script><SCRIPT id='__NEXT_DATA__'>[1]</SCRIPT><script>var x = {"b": 2}; window.y.z = [3]; let f = {"c": {"d": 1}; };</script><script type="application/json">{bad}</script>"""
    assert webjson.script_json_of(html) == ['{"a":1}', "[1]"]
    assert webjson.inline_json_of(html) == ['{"b":2}', "[3]"]
    assert webjson.script_json_of(None) == [] and webjson.inline_json_of("") == []


def test_harvest(spark):
    rows = [
        ("p", 1, "application/json", '{"a": 1}'), ("p", 2, "", ' [1, 2] '), ("p", 3, "text/javascript", 'cb({"a":1});'), ("p", 4, "text/html", '<script type="application/json">{"z":0}</script>'),
        ("p", 5, "application/json", "{broken"), ("p", 6, None, "  "), ("q", 1, None, None), ("q", 2, "application/json", '{"a":1}'),
    ]
    df = spark.createDataFrame(rows, "page string, entry bigint, ct string, b string")
    html = spark.createDataFrame([("p", "dom", "var y = [9];"), ("p", "server", "var x = [8];")], "page string, kind string, html string")
    items = harvest.response_items(df, "page", "entry", "ct", "b").unionByName(harvest.page_items(html, "page", "kind", "html"))
    out = {(r.page, r.item_no): (r.origin, r.payload) for r in harvest.number_items(items).collect()}
    assert out == {
        ("p", 1): ("har:json", '{"a":1}'), ("p", 2): ("har:json", "[1,2]"), ("p", 3): ("har:html", '{"z":0}'), ("p", 4): ("html:server", "[8]"), ("p", 5): ("html:dom", "[9]"), ("q", 1): ("har:json", '{"a":1}'),
    }
    assert json.loads(out["p", 2][1]) == [1, 2]


def test_literals_like_one_pattern():
    import random
    import re
    import time

    naive = re.compile(r"(?:\w+\.[\w.$]+|(?:var|let|const)\s+[\w$]+)\s*=\s*(\{.*?\}|\[.*?\])\s*;", re.I | re.S | re.A)
    r = random.Random(4)
    bits = ["var x = ", "a.b.c=", "let y =", "{", "}", "[1]", "]", ";", " ", "\n", '{"k": 1}', "1", ",", "x"]
    for _ in range(3000):
        text = "".join(r.choices(bits, k=r.randint(1, 14)))
        want = [c for c in map(webjson.canonical, (m[1] for m in naive.finditer(text))) if c is not None]
        assert webjson.inline_json_of(text) == want, text
    began = time.time()
    webjson.inline_json_of("a.b={c:1}\n" * 50_000 + "x" * 300_000)
    assert time.time() - began < 10


def test_scripts_and_literals_of_decoded_bodies(spark, tmp_path):
    """Every response's decoded body is searched, like each body by itself."""
    from tracewell.plans.pages import query

    page = """<ScRipT type="application/json">{"k": "ä"}</ScRipT><script>var x = {"b": 2}; w.y = [3];</script>"""
    code = lambda name: base64.b64encode(page.encode(name)).decode()
    rows = [
        (1, page, None, "text/html"), (2, code("utf-8"), "base64", "text/html"), (3, code("latin-1"), " BASE64", "text/html; charset=iso-8859-1"), (4, code("utf-8"), None, "text/html"),
        (5, None, None, None), (6, "", "base64", None), (7, "no = script", None, None), (8, "abc", "base64", "text/html"),
    ]
    spark.createDataFrame([(k, t, e, m, "h", 0) for k, t, e, m in rows], "entry_id bigint, text string, encoding string, mimetype string, hash string, entry_no int").write.parquet(f"{tmp_path}/har_responses.parquet")
    for name, of in (("ref_p22_script_json", webjson.script_json_of), ("ref_p23_inline_json", webjson.inline_json_of)):
        want = [(k, i, p) for k, t, e, m in rows for i, p in enumerate(of(body.decode_body(t, e, m)))]
        got = sorted(tuple(r) for r in query.queries[name](spark, str(tmp_path)).select("entry_id", "pos", "payload").collect())
        assert got == want and {k for k, _, _ in got} == {1, 2, 3}, name


def test_queries_on_decoded_bodies(spark, tmp_path):
    """The decoded forms of queries whose SQL reads raw texts, against each body by itself."""
    from tracewell.operators import classify
    from tracewell.plans.pages import query
    from tracewell.plans.texts import query as texts

    code = lambda t: base64.b64encode(t.encode()).decode()
    rows = [
        (1, 'cb({"a":1});', None, None, "h1"), (2, code('cb({"a":2});'), "base64", None, "h1"), (3, code('{"to": "ann@b.test"}'), "BASE64", None, "h2"), (4, code("<!doctype html>+4412345678"), "base64", None, None), (5, None, None, "text/html", "h1"),
        (6, code("call +4412345678"), "base64", None, "done"), (7, code("  "), "base64", None, "h1"), (8, code("w " * 25_000 + "ann@b.test 123-45-6789"), "base64", "text/plain", "h1"), (9, code("no data"), None, None, "h1"),
    ]
    spark.createDataFrame([(*r, 0) for r in rows], "entry_id bigint, text string, encoding string, mimetype string, hash string, entry_no int").write.parquet(f"{tmp_path}/har_responses.parquet")
    spark.createDataFrame([("done",), (None,)], "hash string").write.parquet(f"{tmp_path}/har_captures.parquet")
    run = lambda q, name: sorted(tuple(r) for r in q.queries[name](spark, str(tmp_path)).collect())
    bodies = {k: body.decode_body(t, e, m) for k, t, e, m, _ in rows}
    assert [k for k, _ in run(query, "ref_p19_jsonp_decoded")] == [1, 2] and [k for k, _ in run(query, "ref_p19_jsonp")] == [1]
    sniffed = {k: (j, h) for k, j, h in run(query, "ref_p20_sniff_decoded")}
    assert sniffed == {k: (b[:1] in "{[" and b != "", b.startswith("<!doctype")) for k, b in bodies.items() if k != 5}
    import re

    want = []
    for k, _, _, _, page in rows:
        b = bodies[k]
        if page != "done" and b.strip():
            starts = [0] if len(b) <= 50_000 else range(0, len(b) - 50, 49_950)
            found = dict.fromkeys(x for i in starts for x, r in classify.RULES if re.search(r, b[i : i + 50_000]))
            want.append((k, len(b) > 50_000, len(starts), "Y,{" + ",".join(found) + "}" if found else "N,{}"))
    got = run(texts, "c7_classify_logs_decoded")
    assert got == want and {k for k, _, _, r in got if r[0] == "Y"} == {3, 4, 8} and [n for k, _, n, _ in got if k == 8] == [2]
