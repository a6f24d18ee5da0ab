import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.operators import links, ocr
from tracewell.sources import files
from tracewell.sources.sqlite import read_sqlite_dir
from tracewell.streaming.incremental import append_new, message_time, stream_links


def test_sqlite_directory(spark, tmp_path):
    for name, tables in {"b.db": {"t": [("x", 3)]}, "a.db": {"m": [("hi", 1), ("yo\nline", 2)], "wide": [("w", 5)]}, "c.DB": {"u": [("no", 0)]}, "empty.db": {}}.items():
        with sqlite3.connect(tmp_path / name) as db:
            for t, rows in tables.items():
                if t == "wide":
                    db.execute("create table wide (p text, q integer, r text)")
                    db.executemany("insert into wide values (?, ?, 'z')", rows)
                else:
                    db.execute(f"create table {t} (id integer primary key autoincrement, message text, n integer)" if t == "m" else f"create table {t} (message text, n integer)")
                    db.executemany(f"insert into {t} (message, n) values (?, ?)", rows)
    df = read_sqlite_dir(spark, str(tmp_path), batch_size=1)
    assert df.columns == ["_db", "_table", "_seq", "id", "message", "n"]
    rows = [tuple(r)[3:] for r in df.orderBy("_seq").collect()]
    assert rows == [("1", "hi", "1"), ("2", "yo\nline", "2"), ("w", "5", "z"), ("x", "3", None)]
    with pytest.raises(Exception, match="columns"):
        read_sqlite_dir(spark, str(tmp_path), strict=True).collect()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(' a "q", x\nline ', None), ("", "z")], "message string, t string")
    for quote_all in (False, True):
        path = str(tmp_path / f"c{quote_all}")
        files.write_csv(df, path, quote_all=quote_all)
        back = files.read_csv(spark, path, ["message", "t", "absent"])
        assert {tuple(r) for r in back.collect()} == {(' a "q", x\nline ', "", ""), ("", "z", "")}
    none = str(tmp_path / "none")
    files.write_csv(df.limit(0), none)
    assert files.read_csv(spark, none, ["message"]).count() == 0
    (tmp_path / "s.csv").write_text("a,b\n1,2\n3\n")
    assert [r.v for r in files.by_position(files.read_csv(spark, str(tmp_path / "s.csv")), 1, "v").collect()] == ["2"]


def test_mapping_and_ranks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('"orig_url","final_url","hash","status"\n"http://a/""q""","f","h","mapped"\nbroken,row\n')
    assert [tuple(r) for r in files.read_mapping(spark, str(tmp_path / "m.csv")).collect()] == [('http://a/"q"', "f", "h", "mapped")]
    (tmp_path / "r.csv").write_text("1,A.com\n2,b.com\n")
    assert files.read_ranks(spark, str(tmp_path / "r.csv")).count() == 2
    (tmp_path / "bad.csv").write_text("x,b.com\n")
    with pytest.raises(Exception):
        files.read_ranks(spark, str(tmp_path / "bad.csv")).collect()


def test_columns(spark):
    df = spark.createDataFrame([("u", "f", "h", "s")], "a string, b string, c string, d string")
    assert files.resolve_columns(df).columns == ["orig_url", "hash", "status"]
    with pytest.raises(ValueError):
        files.resolve_columns(df.select("a", "b"))
    with pytest.raises(ValueError):
        files.require_columns(df, "image_name", "a")
    two = spark.createDataFrame([(" n ", None), ("", "x"), (None, "y")], "image_name string, extracted_text string")
    assert [tuple(r) for r in files.require_columns(two, "image_name", "extracted_text").collect()] == [("n", "")]


def test_images(spark, tmp_path):
    for p in ("x/a.png", "y/a.PNG", "y/b.txt"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_bytes(b"same")
    df = files.with_names(files.read_images(spark, str(tmp_path), content=False))
    assert sorted((r.name, r.stem) for r in df.collect()) == [("a.PNG", "a"), ("a.png", "a")]
    out = files.with_destination(df.withColumn("path", F.lower("path"))).collect()
    assert {r.n_same for r in out} == {2} and sum(r.wins for r in out) == 1
    files.copy_files(df.filter("name = 'a.png'"), "path", F.lit("pii"), str(tmp_path / "out"))
    assert (tmp_path / "out/pii/a.png").read_bytes() == b"same"


def test_numbered(spark):
    df = spark.createDataFrame([("k", ' 1 [har:json] {"a":1}\n2 [ html:dom ]  \n3 [x] two\nlines\n'), ("n", "no header"), ("e", ""), ("z", None)], "k string, t string")
    out = [(r.k, r.number, r.origin, r.payload) for r in files.numbered_payloads(df, "k", "t").orderBy("item_no").collect()]
    assert out == [("k", 1, "har:json", '{"a":1}'), ("k", 3, "x", "two\nlines")]


def test_keywords_and_clusters(spark):
    words = spark.createDataFrame([("a, b\nnine,a",)], "value string")
    assert {tuple(r) for r in files.keywords(words).collect()} == {("a", 0), ("b", 1), ("nine", 2)}
    lines = spark.createDataFrame([("one\n\n two,\nnine",)], "value string")
    assert [r.keyword for r in files.keywords(lines.select(F.regexp_replace("value", ",", "").alias("value"))).orderBy("ord").collect()] == ["one", "two", "nine"]
    text = spark.createDataFrame([("x\n## A & B \n- one\n - two \n##C\n## D\n- three",)], "value string")
    assert [(r.category, r.keyword) for r in files.clusters(text).orderBy("ord").collect()] == [("A & B", "one"), ("A & B", "two"), ("D", "three")]


def test_text_functions(spark):
    row = spark.createDataFrame([("　 Ab ab\tAB c \xa0", "x" * 161)], "a string, b string")
    got = row.select(tx.strip(F.col("a")), tx.dedupe_words(F.col("a")), tx.preview(F.col("b")), tx.has_alpha(F.lit("12")), tx.blank(F.lit(" ")), tx.blank(F.lit(None)), tx.nfkc(F.lit("ﬁx")), tx.scripts(F.lit("aя漢"))).first()
    assert tuple(got) == ("Ab ab\tAB c", "Ab c", "x" * 160 + "...", False, True, True, "fix", ["cjk", "latin", "cyril"])


def test_ocr(spark):
    def boxes(rows):
        return spark.createDataFrame(rows, "image_name string, lang string, tile int, box int, text string, score double, img_w int, img_h int, poly array<struct<x:double,y:double>>")

    big, small = [(0.0, 0.0), (10.0, 0.0), (10.0, 15.0), (0.0, 15.0)], [(0.0, 0.0), (10.0, 0.0), (10.0, 14.9), (0.0, 14.9)]
    rows = [("i", "en", 0, 0, "keep", 0.9, 10, 10, big), ("i", "en", 0, 1, "low", 0.8999, 10, 10, big), ("i", "en", 0, 2, "tiny", 0.99, 10, 10, small), ("i", "en", 1, 0, "nopoly", 1.0, 10, 10, None), ("i", "en", 1, 1, "null", None, 10, 10, big), ("i", "en", 1, 2, None, 1.0, 10, 10, None)]
    out = ocr.language_texts(ocr.good_boxes(boxes(rows))).collect()
    assert [(r.text, round(r.score, 6)) for r in out] == [("keep nopoly", round((0.9 * 4 + 1.0 * 6) / 10, 6))]
    texts = [
        ("fast", "ch", "漢字", 0.95), ("fast", "en", "english words here", 0.99), ("two", "en", "english words here", 0.9), ("two", "ru", "русские слова тут", 0.85), ("two", "ch", "", 0.0),
        ("short", "en", "english words h", 0.9), ("short", "ru", "русские слова", 0.85), ("none", "ch", "", 0.0), ("one", "en", "a b A", 0.9),
    ]
    fused = {r.image_name: (r.extracted_text, r.langs) for r in ocr.fuse(spark.createDataFrame(texts, "image_name string, lang string, text string, score double")).collect()}
    assert fused == {"fast": ("漢字", ["ch"]), "two": ("english words here русские слова тут", ["en", "ru"]), "short": ("english words h", ["en"]), "none": ("", []), "one": ("a b A", ["en"])}
    tiles = ocr.tiles(spark.createDataFrame([("a", 3200, 3201), ("b", 6300, 100)], "k string, w int, h int"), "k", "w", "h").orderBy("k", "tile").collect()
    assert [tuple(r)[1:] for r in tiles] == [(0, 0, 0, 3200, 3200), (1, 0, 3040, 3200, 3201), (0, 0, 0, 3200, 100), (1, 3040, 0, 6240, 100), (2, 6080, 0, 6300, 100)]
    assert len(ocr.LANGUAGES) == 43


def test_stream(spark, tmp_path):
    schema = "msg_id long, message string, at timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, texts in enumerate((["www.a.com www.a.com", "x"], ["www.a.com www.b.org"])):
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "msg_id long, message string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        append_new(links.valid_urls(stream, "message").select("url"), "url", out, str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(out).count() == k + 1
    for event_time in (None, "at"):
        q = stream_links(spark.readStream.schema(schema).parquet(source), "message", event_time).writeStream.format("memory").queryName(f"links_{event_time}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {r.url for r in spark.sql(f"select url from links_{event_time}").collect()} == {"www.a.com", "www.b.org"}
    times = spark.createDataFrame([("2024-03-01T00:00:00Z",), ("01.03.2024 00:36",), ("soon",), (None,)], "t string").select(message_time(F.col("t")).cast("string").alias("t"))
    assert [r.t for r in times.collect()] == ["2024-03-01 00:00:00", "2024-03-01 00:36:00", None, None]
