import pytest

from tracewell.operators import dedupe


def test_first_by_clashing_names(spark):
    df = spark.createDataFrame([(1, 5, "b", "x"), (1, 4, "a", "y"), (None, 1, "n", "z"), (1, 4, "a", "y")], "key int, ord int, _row string, `a.b` string")
    assert {tuple(r) for r in dedupe.first_by(df, ["key"], ["ord"]).collect()} == {(1, 4, "a", "y"), (None, 1, "n", "z")}
    again = dedupe.first_by(dedupe.first_by(df, ["key"], ["ord"]), ["key"], ["ord"])
    assert again.count() == 2
    assert dedupe.first_by(df.limit(0), ["key"], ["ord"]).count() == 0


def test_content_duplicates(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, ""), (5, None)], "doc int, text string")
    assert {tuple(r)[0::2] for r in dedupe.content_duplicates(df, "doc", "text").select("doc", "digest", "survivor").collect()} == {(3, 1), (1, 1), (2, 2), (4, 4), (5, 2)}


def test_crawl_status_and_resume(spark):
    df = spark.createDataFrame([("p", 1), ("p", 2), (None, 3), (None, 4)], "page string, seq int")
    assert {(r.seq, r.crawl_status) for r in dedupe.crawl_status(df, "page", "seq").collect()} == {(1, "mapped"), (2, "skipped"), (3, "mapped"), (4, "skipped")}
    done = spark.createDataFrame([("p",)], "x string")
    assert [r.seq for r in dedupe.not_done(df, "page", done, done).orderBy("seq").collect()] == [3, 4]


def test_union_by_position(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y",)], "other string")
    c = spark.createDataFrame([(2, "z", 3.0)], "p int, q string, r double")
    assert sorted(map(tuple, dedupe.union_by_position(a, b, c).collect()), key=str) == [("1", "x"), ("2", "z"), ("y", None)]
    with pytest.raises(ValueError):
        dedupe.union_by_position(a, b, strict=True)


def test_dense_numbers_of_a_hot_group(spark):
    df = spark.range(0, 900).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 7)) as g", "id as o")
    out = dedupe.dense_numbers(df, "g", ["o"], "no").collect()
    by = {}
    for r in sorted(out, key=lambda r: r.o):
        by.setdefault(r.g, []).append(r.no)
    assert len(out) == 900 and all(v == list(range(1, len(v) + 1)) for v in by.values())


def test_clashing_names(spark):
    from tracewell.operators import domains, links
    from tracewell.sources import files

    df = spark.createDataFrame([(1, "h", "http://a.com", None, None, "z")], "seq int, hash string, url string, _row int, _done int, tranco_rank string")
    df = df.selectExpr("*", "1 as _key", "2 as _first", "3 as _last", "4 as pos", "5 as raw_url", "'x' as crawl_status", "6 as wins")
    names = spark.createDataFrame([("h.png",)], "name string")
    ranks = spark.createDataFrame([("a.com", 5)], "domain string, tranco_rank int")
    assert domains.keep_surviving(df, names, "seq").columns == df.columns
    assert dedupe.not_done(df, "hash", names).columns == df.columns
    assert dedupe.crawl_status(df, "hash", "seq").select("crawl_status", "_key", "_first").first() == ("mapped", 1, 2)
    assert domains.with_rank(df, "url", ranks).select("tranco_rank").first() == (5,)
    assert [r.pos for r in links.found_urls(df, "url").collect()] == [0]
    assert links.valid_urls(df, "url").select("url", "pos").first() == ("http://a.com", 0)
    assert files.with_destination(df, "url", "seq").select("wins", "_last").first() == (True, 3)
    assert dedupe.first_by(df, ["hash"], ["seq"]).columns == df.columns


def test_sinks(spark, tmp_path):
    from tracewell.sources import files

    df = spark.createDataFrame([("b", "k1"), ("a", "k1"), ("b", "k2"), (None, "k2")], "url string, k string")
    files.write_sorted_lines(df, "url", str(tmp_path / "lines"))
    lines = [x for p in sorted((tmp_path / "lines").glob("part-*")) for x in p.read_text().split()]
    assert lines == ["a", "b"]
    files.write_per_key(df, "k", str(tmp_path / "keys"))
    assert sorted(p.name for p in (tmp_path / "keys").glob("k=*")) == ["k=k1", "k=k2"]
    for _ in range(2):
        files.append_results(df, str(tmp_path / "more"))
    assert spark.read.parquet(str(tmp_path / "more")).count() == 8
    files.write_jsonl(df.select("url"), str(tmp_path / "json"))
    assert any('{"url":null}' in p.read_text() for p in (tmp_path / "json").glob("part-*"))
