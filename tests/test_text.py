import time

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.functions import webjson
from tracewell.functions.language import detect_language
from tracewell.functions.status import final_status, status_class
from tracewell.operators import dedupe, domains
from tracewell.sources import files


def test_strip_is_linear(spark):
    df = spark.createDataFrame([("a" + " " * 1_000_000 + "b",), (" \x1c x 　",), (None,)], "s string")
    df.select(tx.strip("s")).collect()
    began = time.time()
    out = [r[0] for r in df.select(tx.strip(F.col("s"))).collect()]
    assert time.time() - began < 5 and len(out[0]) == 1_000_002 and out[1:] == ["x", None]
    assert [r[0] for r in df.select(tx.nonblank(F.col("s"))).collect()] == [True, True, False]


def test_sniffing_reads_behind_white_space(spark):
    df = spark.createDataFrame([(" " * 5_000 + '{"a": 1}',), ("\n" * 9_000 + "<!DOCTYPE html>",), ("x" * 1_990 + "<html>",), ("x" * 2_001 + "<html>",)], "b string")
    none = F.lit("")
    out = [(r.j, r.h) for r in df.select(webjson.looks_like_json(none, F.col("b")).alias("j"), webjson.looks_like_html(none, F.col("b")).alias("h")).collect()]
    assert out == [(True, False), (False, True), (False, True), (False, False)]


#: Held out: in none of the profiles' texts.
SENTENCES = [
    ("en", "The children walked to school through the snow this morning."), ("de", "Die Kinder gingen heute durch den Schnee zur Schule."), ("fr", "Les enfants marchaient vers l'école dans la neige."), ("es", "Los niños caminaban a la escuela por la nieve."),
    ("it", "I bambini camminavano verso la scuola sotto la neve."), ("pt", "As crianças caminharam para a escola pela neve."), ("nl", "De kinderen liepen vanmorgen door de sneeuw naar school."), ("sv", "Barnen gick till skolan genom snön i morse."), ("fi", "Lapset kävelivät aamulla lumen läpi kouluun."),
    ("et", "Lapsed kõndisid hommikul läbi lume kooli."), ("pl", "Dzieci szły dziś rano przez śnieg do szkoły."), ("cs", "Děti šly dnes ráno sněhem do školy."), ("hu", "A gyerekek ma reggel a hóban mentek iskolába."), ("ro", "Copiii au mers azi dimineață prin zăpadă la școală."), ("tr", "Çocuklar bu sabah karda okula yürüdüler."),
    ("ru", "Дети шли утром по снегу в школу."), ("uk", "Діти йшли вранці по снігу до школи."), ("ja", "子どもたちは雪の中を学校へ歩いた。"), ("zh", "孩子们今天早上踏雪去上学。"), ("ko", "아이들은 눈길을 걸어 학교에 갔다."), (None, "12 34 :-)"), (None, ""), (None, None),
]


def test_languages(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(SENTENCES)], "i int, t string")
    got = {r.i: r.lang for r in df.select("i", detect_language(F.col("t")).alias("lang")).collect()}
    wrong = [(want, got[i], t) for i, (want, t) in enumerate(SENTENCES) if got[i] != want]
    assert len(wrong) <= 2, wrong


def test_status_that_a_page_keeps(spark):
    rows = [("a", "ok", 1), ("a", "partial-dom", 2), ("b", "partial-server-html", 1), ("b", "partial-dom", 2), ("b", "Partial-har-close", 3), ("c", "partial-server-html", 1), ("c", " OK ", 2), ("c", "partial-dom", 3), ("d", None, 1), ("e", "error: x", 1), (None, "ok", 1)]
    df = spark.createDataFrame(rows, "page string, status string, seq int")
    assert {r.page: r.status for r in final_status(df, "page", "status", "seq").collect()} == {"a": "partial-dom", "b": "partial-server-html", "c": "partial-dom", "e": "error: x", None: "ok"}
    assert [r[0] for r in df.select(status_class(F.col("status"))).collect()][:2] == ["ok", "partial"]
    assert final_status(df.limit(0), "page", "status", "seq").count() == 0


def test_csv_appends(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.createDataFrame([(1, 'a "b", c')], "id int, `text, here` string")
    two = spark.createDataFrame([(2, None), (3, "line\nbreak")], "id int, `text, here` string")
    files.append_csv(one, path)
    files.append_csv(two, path)
    assert sorted(map(tuple, files.read_appended(spark, path).collect())) == [("1", 'a "b", c'), ("2", None), ("3", "line\nbreak")]
    assert (tmp_path / "out" / files.HEADER).read_text() == 'id,"text, here"\n'
    with pytest.raises(ValueError):
        files.append_csv(one.withColumnRenamed("id", "x"), path)


def test_hot_keys_are_spread(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else str(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, k string")
    lookup = spark.createDataFrame([("hot", 1), (None, 2), ("5", 3)], "k string, v int")
    out = {r.id: r.v for r in dedupe.spread_join(df, ["k"], lookup, ["id"]).collect()}
    assert out == {i: 1 if k == "hot" else 2 if k is None else 3 if k == "5" else None for i, k in rows}
    ranked = domains.with_rank(spark.createDataFrame([(1, "http://a.test/x"), (2, None), (2, "http://b.test")], "seq int, u string"), "u", spark.createDataFrame([("a.test", 7)], "domain string, tranco_rank int"))
    assert sorted(((r.seq, r.tranco_rank) for r in ranked.collect()), key=str) == [(1, 7), (2, None), (2, None)]


def test_pages_of_all_origins(spark):
    """One page of each origin: JSON, JSONP, HTML with a data script and an assigned literal, stored pages."""
    from tracewell.operators import harvest

    html = '<html><Script type="application/json">{"a": 1}</script><script>var s = {"b": [1]};</script></html>'
    rows = [("p", 1, "", '{"z": 1, "a": 2}'), ("p", 2, "", ' cb({"c": 1}); '), ("p", 3, "text/html", html), ("p", 4, "", '{"a":2,"z":1}'), ("p", 5, "", None), ("p", 6, "", "  "), (None, 1, "", "[1]")]
    items = harvest.response_items(spark.createDataFrame(rows, "page string, entry int, ct string, b string"), "page", "entry", "ct", "b")
    pages = harvest.page_items(spark.createDataFrame([("p", "server", html), ("p", "dom", "<html>window.x = [2];</html>")], "page string, kind string, t string"), "page", "kind", "t")
    out = sorted((r.item_no, r.origin, r.payload) for r in harvest.number_items(items.unionByName(pages)).collect() if r.page)
    assert out == [(1, "har:json", '{"a":2,"z":1}'), (2, "har:jsonp", '{"c":1}'), (3, "har:html", '{"a":1}'), (4, "har:html", '{"b":[1]}'), (5, "html:dom", "[2]")]


def test_two_scripts_are_fused(spark):
    from tracewell.operators import ocr

    rows = [("i", "en", 0, 1, "hello hello there my friend", 0.93), ("i", "ru", 0, 1, "привет привет мой друг здесь", 0.92), ("j", "ch", 0, 1, "only this", 0.97)]
    boxes = spark.createDataFrame(rows, "image_name string, lang string, tile int, box int, text string, score double")
    got = {r.image_name: (r.extracted_text, r.langs) for r in ocr.fuse(ocr.language_texts(boxes)).collect()}
    assert set(got["i"][0].split()) == set("hello there my friend привет мой друг здесь".split()) and sorted(got["i"][1]) == ["en", "ru"] and got["j"] == ("only this", ["ch"])
    plan = ocr.fuse(ocr.language_texts(boxes))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
