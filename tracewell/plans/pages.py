"""Queries over captured responses and OCR detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import webjson
from tracewell.functions.body import body
from tracewell.functions.text import SPACE, nonblank
from tracewell.io import table
from tracewell.operators import harvest, ocr
from tracewell.operators.nested import HarTables
from tracewell.plans.links import sql_strip
from tracewell.plans.registry import Registry
from tracewell.sources import files

query = Registry()


def _responses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "har_responses")


@query("ref_p15_headers", """WITH v AS (SELECT capture_id, CAST(har AS JSON) AS j FROM har_captures WHERE json_valid(har) AND trim(har) <> ''),
 e AS (SELECT capture_id, unnest(range(CAST(json_array_length(j, '$.log.entries') AS BIGINT))) AS i, j FROM v WHERE json_type(j, '$.log.entries') = 'ARRAY'),
 c AS (SELECT capture_id, CAST(i + 1 AS INTEGER) AS entry_no, json_extract(j, '$.log.entries[' || i || '].response.headers') AS h FROM e),
 l AS (SELECT capture_id, entry_no, k, json_extract(h, '$[' || k || ']') AS x FROM (SELECT *, unnest(range(CAST(json_array_length(h) AS BIGINT))) AS k FROM c WHERE json_type(h) = 'ARRAY')),
 n AS (SELECT capture_id, entry_no, k, json_extract_string(x, '$.name') AS name, json_extract_string(x, '$.value') AS value FROM l
 UNION ALL SELECT capture_id, entry_no, k, name, json_extract_string(h, '$."' || name || '"') FROM (SELECT *, unnest(range(len(json_keys(h)))) AS k, unnest(json_keys(h)) AS name FROM c WHERE json_type(h) = 'OBJECT'))
 SELECT capture_id, entry_no, lower(name) AS header, arg_max(coalesce(value, ''), k) AS value FROM n WHERE name <> '' GROUP BY 1, 2, 3""")
def p15(spark, d):
    """Header map of each captured entry that has headers."""
    rows = HarTables(table(spark, d, "har_captures")).headers().filter("name <> ''")
    lists = rows.groupBy("capture_id", "entry_no").agg(F.array_sort(F.collect_list(F.struct("header_no", "name", "value"))).alias("h"))
    return lists.select("capture_id", "entry_no", F.explode(webjson.header_map(F.col("h"))).alias("header", "value"))


@query("ref_p16_ctype", "SELECT entry_id, lower(coalesce(nullif(mimetype, ''), '')) AS ctype FROM har_responses")
def p16(spark, d):
    none = F.create_map().cast("map<string,string>")
    return _responses(spark, d).select("entry_id", webjson.content_type(F.col("mimetype"), none).alias("ctype"))


@query("ref_p17_charset", "SELECT entry_id, regexp_extract(coalesce(mimetype, ''), '(?i);\\s*charset=\\s*[\"'']?([^;\"'']*?)[\"'']?\\s*(?:;|$)', 1) AS charset FROM har_responses")
def p17(spark, d):
    return _responses(spark, d).select("entry_id", webjson.charset(F.col("mimetype")).alias("charset"))


def _bodies(spark, d, where: str = "true") -> DataFrame:
    return _responses(spark, d).filter(where).select("entry_id", "hash", "entry_no", "mimetype", body(F.col("text"), F.col("encoding"), F.col("mimetype")).alias("body"))


@query("ref_p18_body")
def p18(spark, d):
    """Digest and length of every decoded body."""
    return _bodies(spark, d).select("entry_id", F.char_length("body").alias("chars"), F.md5("body").alias("digest"))


@query("f5_nonblank", f"SELECT entry_id FROM har_responses WHERE {sql_strip('text')} <> ''")
def f5(spark, d):
    return _responses(spark, d).filter(nonblank(F.col("text"))).select("entry_id")


@query("ref_p19_jsonp", f"SELECT entry_id, md5(p) AS digest FROM (SELECT entry_id, regexp_extract(text, '{webjson._JSONP}', 1) AS p FROM har_responses) WHERE p <> ''")
def p19(spark, d):
    rows = _responses(spark, d).select("entry_id", webjson.unwrap_jsonp(F.col("text")).alias("p")).filter("p <> ''")
    return rows.select("entry_id", F.md5("p").alias("digest"))


@query("ref_p19_jsonp_decoded")
def p19b(spark, d):
    """What JSONP calls pass, of decoded bodies."""
    rows = _bodies(spark, d).select("entry_id", webjson.unwrap_jsonp(F.col("body")).alias("p")).filter("p <> ''")
    return rows.select("entry_id", F.md5("p").alias("digest"))


LSTRIPPED = f"regexp_replace(text, '^[{SPACE}]+', '')"


@query("ref_p20_sniff", f"""SELECT entry_id, coalesce(contains(lower(mimetype), 'json'), false) OR left({LSTRIPPED}, 1) IN ('{{', '[') AS json,
 coalesce(contains(lower(mimetype), 'text/html'), false) OR starts_with(lower({LSTRIPPED}), '<!doctype html') OR contains(lower(left({LSTRIPPED}, 2000)), '<html') AS html
 FROM har_responses WHERE text IS NOT NULL""")
def p20(spark, d):
    ct, b = F.col("mimetype"), F.col("text")
    return _responses(spark, d).filter("text is not null").select("entry_id", webjson.looks_like_json(ct, b).alias("json"), webjson.looks_like_html(ct, b).alias("html"))


@query("ref_p20_sniff_decoded")
def p20b(spark, d):
    """JSON-like and HTML-like responses by type and decoded body."""
    ct, b = F.col("mimetype"), F.col("body")
    rows = _bodies(spark, d, "text is not null")
    return rows.select("entry_id", webjson.looks_like_json(ct, b).alias("json"), webjson.looks_like_html(ct, b).alias("html"))


@query("ref_p21_json_canon", "SELECT event_id, replace(props, ' ', '') AS canon FROM events")
def p21(spark, d):
    return table(spark, d, "events").select("event_id", webjson.canonical_json(F.col("props")).alias("canon"))


@query("ref_p21_json_key", "SELECT event_id, replace(props, ' ', '') AS json_key FROM events")
def p21b(spark, d):
    return table(spark, d, "events").select("event_id", webjson.fast_json_key(F.col("props")).alias("json_key"))


@query("ref_p22_script_json")
def p22(spark, d):
    rows = _bodies(spark, d).filter(F.col("body").rlike("(?i)<script"))
    return rows.select("entry_id", F.posexplode(webjson.script_json(F.col("body"))).alias("pos", "payload"))


@query("ref_p23_inline_json")
def p23(spark, d):
    return _bodies(spark, d).filter(F.col("body").contains("=")).select("entry_id", F.posexplode(webjson.inline_json(F.col("body"))).alias("pos", "payload"))


FIRST_PROPS = """SELECT user_id, p, min(event_id) AS e FROM (SELECT user_id, event_id, replace(props, ' ', '') AS p FROM events) GROUP BY 1, 2"""
NUMBERED = f"SELECT user_id AS page, CAST(row_number() OVER (PARTITION BY user_id ORDER BY e) AS INTEGER) AS item_no, 'har:json' AS origin, p AS payload FROM ({FIRST_PROPS})"


def _props(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("entry"), F.lit("application/json").alias("ct"), F.col("props").alias("b"))
    return harvest.number_items(harvest.response_items(rows, "page", "entry", "ct", "b"))


@query("w3_json_dedupe_number", NUMBERED)
def w3(spark, d):
    return _props(spark, d)


@query("ref_p31_numbered", f"SELECT page, item_no, item_no || ' [' || origin || '] ' || payload AS line FROM ({NUMBERED})")
def p31(spark, d):
    return files.numbered_lines(_props(spark, d), "page", "item_no", "origin", "payload")


def _typed(spark, d) -> DataFrame:
    """(capture_id, entry_no, ctype, text, encoding, mimetype) of captured contents: the type they name, else their header's."""
    har = HarTables(table(spark, d, "har_captures"))
    heads = har.headers().filter("name <> ''").groupBy("capture_id", "entry_no").agg(F.array_sort(F.collect_list(F.struct("header_no", "name", "value"))).alias("h"))
    both = har.contents().join(heads, ["capture_id", "entry_no"], "left")
    headers = F.coalesce(webjson.header_map(F.col("h")), F.create_map().cast("map<string,string>"))
    return both.select("capture_id", "entry_no", webjson.content_type(F.col("mimetype"), headers).alias("ctype"), "text", "encoding", "mimetype")


def _captured(spark, d) -> DataFrame:
    """(hash, entry_id, ct, body) of captured contents; they come after the responses, in the order of captures."""
    pages = table(spark, d, "har_captures").select("capture_id", "hash")
    rows = _typed(spark, d).join(pages, "capture_id")
    place = F.lit(1 << 50) + F.col("capture_id") * 100_000 + F.col("entry_no")
    return rows.select("hash", place.alias("entry_id"), F.col("ctype").alias("ct"), body(F.col("text"), F.col("encoding"), F.col("ctype")).alias("body"))


CONTENTS = """WITH v AS (SELECT capture_id, CAST(har AS JSON) AS j FROM har_captures WHERE json_valid(har) AND trim(har) <> ''),
 e AS (SELECT capture_id, unnest(range(CAST(json_array_length(j, '$.log.entries') AS BIGINT))) AS i, j FROM v WHERE json_type(j, '$.log.entries') = 'ARRAY'),
 c AS (SELECT capture_id, CAST(i + 1 AS INTEGER) AS entry_no, json_extract(j, '$.log.entries[' || i || '].response.content') AS c, json_extract(j, '$.log.entries[' || i || '].response.headers') AS h FROM e)"""


@query("ref_p16_ctype_header", f"""{CONTENTS}, l AS (SELECT capture_id, entry_no, k, json_extract(h, '$[' || k || ']') AS x FROM (SELECT *, unnest(range(CAST(json_array_length(h) AS BIGINT))) AS k FROM c WHERE json_type(h) = 'ARRAY')),
 n AS (SELECT capture_id, entry_no, k, json_extract_string(x, '$.name') AS name, json_extract_string(x, '$.value') AS value FROM l
 UNION ALL SELECT capture_id, entry_no, k, name, json_extract_string(h, '$."' || name || '"') FROM (SELECT *, unnest(range(len(json_keys(h)))) AS k, unnest(json_keys(h)) AS name FROM c WHERE json_type(h) = 'OBJECT')),
 t AS (SELECT capture_id, entry_no, arg_max(coalesce(value, ''), k) AS ct FROM n WHERE lower(name) = 'content-type' GROUP BY 1, 2)
 SELECT capture_id, entry_no, lower(coalesce(nullif(json_extract_string(c, '$.mimeType'), ''), t.ct, '')) AS ctype FROM c LEFT JOIN t USING (capture_id, entry_no) WHERE json_type(c) = 'OBJECT'""")
def p16b(spark, d):
    """The type of captured contents: their own, else their header's."""
    return _typed(spark, d).select("capture_id", "entry_no", "ctype")


@query("c4_json_harvest")
def c4(spark, d):
    """JSON items of every page, from responses, captures and stored HTML."""
    rows = _bodies(spark, d).withColumn("ct", webjson.content_type(F.col("mimetype"), F.create_map().cast("map<string,string>"))).select("hash", "entry_id", "ct", "body")
    items = harvest.response_items(rows.unionByName(_captured(spark, d)), "hash", "entry_id", "ct", "body")
    docs = table(spark, d, "documents").filter(F.col("source").isin("server_html", "dom_html") & F.col("page_hash").isNotNull())
    html = harvest.page_items(docs.select("page_hash", F.substring_index("source", "_", 1).alias("kind"), "text"), "page_hash", "kind", "text")
    return harvest.number_items(items.unionByName(html))


@query("ref_p39_suffix", "SELECT DISTINCT hash || '.png' AS name FROM har_responses WHERE hash IS NOT NULL")
def p39(spark, d):
    return _responses(spark, d).filter("hash is not null").select(F.regexp_replace(F.concat("hash", F.lit(".txt")), r"\.txt$", ".png").alias("name")).distinct()


# OCR detections, made of order lines: an image per order, a box per line


def _lang(c: Column) -> Column:
    return F.when(c == "A", "ch").when(c == "N", "en").otherwise("ru")


def _boxes(spark, d) -> DataFrame:
    w, h = F.col("l_quantity"), F.col("l_discount") * 100 + 1
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0.0)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_name"), _lang(F.col("l_returnflag")).alias("lang"), (F.col("l_linenumber") % 2).cast("int").alias("tile"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("box"), F.concat_ws(" ", F.lit("part"), F.col("l_partkey").cast("string")).alias("text"),
        (F.lit(0.86) + F.col("l_tax")).alias("score"), F.lit(1000).alias("img_w"), F.lit(1000).alias("img_h"),
        F.array(point(zero, zero), point(w * 2, zero), point(w * 2, h), point(zero, h)).alias("poly"))


BOXES = """SELECT l_orderkey AS image_name, CASE l_returnflag WHEN 'A' THEN 'ch' WHEN 'N' THEN 'en' ELSE 'ru' END AS lang, CAST(l_linenumber % 2 AS INTEGER) AS tile,
 l_linenumber, l_partkey, l_suppkey, l_extendedprice, 'part ' || l_partkey AS text, 0.86::DOUBLE + l_tax AS score, l_quantity * 2 * (l_discount * 100::DOUBLE + 1) AS area FROM lineitem"""
GOOD = f"SELECT * FROM ({BOXES}) WHERE score >= 0.90::DOUBLE AND area >= 150"
TILE_TEXT = f"""SELECT image_name, lang, tile, string_agg(text, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text, sum(score * length(text)) / greatest(1, sum(length(text))) AS score FROM ({GOOD}) GROUP BY 1, 2, 3"""
LANG_TEXT = f"SELECT image_name, lang, string_agg(text, ' ' ORDER BY tile) AS text, sum(score * length(text)) / greatest(1, sum(length(text))) AS score FROM ({TILE_TEXT}) GROUP BY 1, 2"
LANG_ORD = "CASE lang WHEN 'ch' THEN 1 WHEN 'en' THEN 3 ELSE 40 END"


@query("ref_p32_area", f"SELECT image_name, l_linenumber, l_partkey, round(area, 4) AS area FROM ({BOXES})")
def p32(spark, d):
    return _boxes(spark, d).select("image_name", "box.l_linenumber", "box.l_partkey", F.round(ocr.polygon_area(F.col("poly")), 4).alias("area"))


@query("f6_ocr_boxes", f"SELECT image_name, l_linenumber, l_partkey, text FROM ({GOOD})")
def f6(spark, d):
    return ocr.good_boxes(_boxes(spark, d)).select("image_name", "box.l_linenumber", "box.l_partkey", "text")


@query("ref_p33_tiles", """WITH s AS (SELECT p_partkey, 1000 + p_size * 200 AS w, 3000 + p_size * 50 AS h FROM part),
 x AS (SELECT *, unnest(range(CASE WHEN w <= 3200 THEN 1 ELSE (w - 161) // 3040 + 1 END)) * 3040 AS x0 FROM s),
 y AS (SELECT *, unnest(range(CASE WHEN h <= 3200 THEN 1 ELSE (h - 161) // 3040 + 1 END)) * 3040 AS y0 FROM x)
 SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY x0, y0) - 1 AS INTEGER) AS tile, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0,
 CAST(least(x0 + 3200, w) AS INTEGER) AS x1, CAST(least(y0 + 3200, h) AS INTEGER) AS y1 FROM y""")
def p33(spark, d):
    images = table(spark, d, "part").select("p_partkey", (F.lit(1000) + F.col("p_size") * 200).cast("int").alias("w"), (F.lit(3000) + F.col("p_size") * 50).cast("int").alias("h"))
    return ocr.tiles(images, "p_partkey", "w", "h")


def _language_texts(spark, d) -> DataFrame:
    return ocr.language_texts(ocr.good_boxes(_boxes(spark, d)))


@query("a4_weighted_score", f"SELECT image_name, lang, text, round(score, 9) AS score FROM ({LANG_TEXT})")
def a4(spark, d):
    return _language_texts(spark, d).withColumn("score", F.round("score", 9))


@query("w6_lang_rank", f"""SELECT image_name, lang, round(utility, 6) AS utility, CAST(row_number() OVER (PARTITION BY image_name ORDER BY utility DESC, ord) AS INTEGER) AS rank
 FROM (SELECT *, score * ln(1 + length(text)) AS utility, {LANG_ORD} AS ord FROM ({LANG_TEXT}))""")
def w6(spark, d):
    out = ocr.ranked_languages(_language_texts(spark, d))
    return out.select("image_name", "lang", F.round("utility", 6).alias("utility"), F.col("rank").cast("int").alias("rank"))


@query("c8_ocr_fusion", f"""WITH t AS (SELECT *, score * ln(1 + length(text)) AS utility, {LANG_ORD} AS ord FROM ({LANG_TEXT})),
 r AS (SELECT *, row_number() OVER (PARTITION BY image_name ORDER BY utility DESC, ord) AS rn FROM t), f AS (SELECT image_name, text FROM t WHERE lang = 'ch' AND score >= 0.95::DOUBLE)
 SELECT r.image_name, coalesce(f.text, r.text) AS extracted_text, CASE WHEN f.text IS NOT NULL THEN 'ch' ELSE r.lang END AS langs FROM r LEFT JOIN f ON f.image_name = r.image_name WHERE rn = 1""")
def c8(spark, d):
    out = ocr.fuse(_language_texts(spark, d))
    return out.select("image_name", "extracted_text", F.array_join("langs", ",").alias("langs"))


@query("o5_audit_head", f"""SELECT image_name, CAST(pos AS INTEGER) AS pos, lang, round(score, 9) AS score, CASE WHEN length(text) > 160 THEN left(text, 160) || '...' ELSE text END AS preview
 FROM (SELECT *, row_number() OVER (PARTITION BY image_name ORDER BY {LANG_ORD}) - 1 AS pos FROM ({LANG_TEXT})) WHERE pos < 8""")
def o5(spark, d):
    """The first languages tried for each image."""
    rows = ocr.audit(_language_texts(spark, d)).select("image_name", F.posexplode("audit").alias("pos", "a"))
    return rows.select("image_name", "pos", "a.lang", F.round("a.score", 9).alias("score"), "a.preview")
