"""Queries over messages, links, mappings and domains."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import urls
from tracewell.functions.status import final_status, status_class
from tracewell.functions.text import SPACE, has_alpha, strip
from tracewell.io import ensure_checkpoint_dir, table
from tracewell.operators import classify, dedupe, domains
from tracewell.operators import links as link_ops
from tracewell.plans.registry import Registry
from tracewell.sources import files
from tracewell.streaming.incremental import append_new

query = Registry()

Q = "'"
FIND_SQL = urls.FIND.replace(Q, Q + Q)
STRIP_RE = f"^[{SPACE}]+|[{SPACE}]+$"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '{STRIP_RE}', '', 'g')"


def sql_norm(c: str) -> str:
    s = sql_strip(c)
    return f"CASE WHEN {s} = '' THEN '' WHEN contains({s}, '://') THEN {s} ELSE 'http://' || {s} END"


def sql_authority(c: str) -> str:
    return f"regexp_extract({c}, '{urls.AUTHORITY}', 1)"


def sql_domain(c: str) -> str:
    """Registered domain of a normalised URL."""
    h = f"lower(split_part(split_part({sql_authority(c)}, '@', -1), ':', 1))"
    return (f"CASE WHEN {h} IN ('', 'localhost') OR regexp_matches({h}, '^[0-9.]+$') OR len(string_split({h}, '.')) < 2 THEN {h}"
            f" ELSE array_to_string(string_split({h}, '.')[-2:], '.') END")  # fmt: skip


def sql_netloc(c: str) -> str:
    s = sql_strip(c)
    return f"CASE WHEN {s} <> '' THEN lower(" + sql_authority(f"(CASE WHEN contains({s}, '://') THEN {s} ELSE 'http://' || {s} END)") + ") END"


def sql_top_n(inner: str, key: str, n: int = 10) -> str:
    """Top-N with the rest of ``inner``, a select with the column ``key``."""
    return f"""WITH d AS ({inner}), c AS (SELECT {key} AS k, count(*) AS n FROM d WHERE {key} <> '' GROUP BY 1),
    r AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k) AS rn, sum(n) OVER () AS total FROM c)
    SELECT CASE WHEN rn <= {n} THEN k ELSE 'Others' END AS {key}, CAST(sum(n) AS BIGINT) AS "count",
    round(sum(n) * 100.0::DOUBLE / max(total), 2) AS percentage FROM r GROUP BY 1"""


MATCHES = f"""SELECT msg_id, to_number, from_number, msg_time, message, unnest(l) AS raw_url, CAST(unnest(range(len(l))) AS INTEGER) AS pos
FROM (SELECT *, regexp_extract_all(message, '{FIND_SQL}') AS l FROM merged_messages)"""
CLEAN = f"""regexp_extract(translate(regexp_replace(split_part(split_part(raw_url, ',', 1), '，', 1), '{urls.TRAILING}', ''), chr(8206) || chr(8207), ''), '{urls.ASCII_PREFIX}')"""
VALID_SQL = f"regexp_matches(CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url ELSE 'http://' || url END, '{urls.VALID}')"
VALID_ROWS = f"SELECT * FROM (SELECT *, {CLEAN} AS url FROM ({MATCHES})) WHERE url <> '' AND NOT contains(url, '*') AND {VALID_SQL}"
FIRST_ROWS = f"SELECT * FROM ({VALID_ROWS}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY msg_id, pos) = 1"
RANKS = "SELECT lower(domain) AS domain, max(site_rank) AS tranco_rank FROM tranco_list GROUP BY 1"
PAGES = "SELECT DISTINCT hash || '.png' AS name FROM har_responses WHERE hash IS NOT NULL"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "merged_messages")


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "url_mapping")


def _page_files(spark: SparkSession, d: str) -> DataFrame:
    """Names of the captured pages' images."""
    return table(spark, d, "har_responses").filter("hash is not null").select(F.concat("hash", F.lit(".png")).alias("name")).distinct()


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return domains.rank_table(table(spark, d, "tranco_list"), "site_rank", "domain", "site_rank")


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tracewell-{uuid.uuid4().hex}"


# Links of messages


@query("ref_p1_url_find", f"SELECT msg_id, pos, raw_url FROM ({MATCHES})")
def p1(spark, d):
    return link_ops.found_urls(_messages(spark, d), "message").select("msg_id", "pos", "raw_url")


@query("f1_has_url", f"SELECT msg_id FROM merged_messages WHERE regexp_matches(message, '{FIND_SQL}')")
def f1(spark, d):
    return _messages(spark, d).filter(F.size(urls.find_urls(F.col("message"))) > 0).select("msg_id")


@query("ref_p2_url_clean", f"SELECT msg_id, pos, url FROM (SELECT *, {CLEAN} AS url FROM ({MATCHES})) WHERE url <> '' AND NOT contains(url, '*')")
def p2(spark, d):
    return link_ops.found_urls(_messages(spark, d), "message").select("msg_id", "pos", urls.clean_url(F.col("raw_url")).alias("url")).filter("url is not null")


@query("ref_p6_url_valid", f"SELECT seq, coalesce({VALID_SQL}, false) AS valid FROM (SELECT seq, orig_url AS url FROM url_mapping)")
def p6(spark, d):
    return _mapping(spark, d).select("seq", urls.is_valid_url(F.col("orig_url")).alias("valid"))


@query("c1_extract_urls", f"SELECT url, to_number, from_number, msg_time, message, msg_id AS seq FROM ({FIRST_ROWS})")
def c1(spark, d):
    out = link_ops.extract_urls(_messages(spark, d), "message", "msg_id")
    return out.select("url", "to_number", "from_number", "msg_time", "message", F.col("msg_id").alias("seq"))


@query("w1_url_dedupe", f"SELECT url, msg_id, pos FROM ({FIRST_ROWS})")
def w1(spark, d):
    return link_ops.extract_urls(_messages(spark, d), "message", "msg_id").select("url", "msg_id", "pos")


@query("a3_extract_stats", f"""SELECT (SELECT count(*) FROM merged_messages WHERE regexp_matches(message, '{FIND_SQL}')) AS messages_with_url,
 count(*) AS valid_urls, count(DISTINCT url) AS distinct_urls FROM ({VALID_ROWS})""")
def a3(spark, d):
    return link_ops.extraction_stats(_messages(spark, d), "message")


@query("o1_sorted_urls", f"SELECT DISTINCT url FROM ({VALID_ROWS}) ORDER BY url")
def o1(spark, d):
    return link_ops.valid_urls(_messages(spark, d), "message").select("url").distinct().orderBy("url")


@query("u3_distinct", f"SELECT DISTINCT url FROM ({VALID_ROWS})")
def u3(spark, d):
    return link_ops.valid_urls(_messages(spark, d), "message").select("url").distinct()


@query("f3_prefix", "SELECT seq, orig_url FROM url_mapping WHERE starts_with(orig_url, 'http://') OR starts_with(orig_url, 'https://') OR starts_with(orig_url, 'www.')")
def f3(spark, d):
    return _mapping(spark, d).filter(urls.has_known_prefix(F.col("orig_url"))).select("seq", "orig_url")


@query("o3_shuffled", "SELECT seq, orig_url FROM url_mapping")
def o3(spark, d):
    """All mapping rows in a random order that a seed fixes."""
    return _mapping(spark, d).select("seq", "orig_url").orderBy(F.xxhash64("seq", F.lit(42)), "seq")


@query("stream_links", f"SELECT DISTINCT url FROM ({VALID_ROWS})")
def stream(spark, d):
    """Links of a message stream, appended to a table batch by batch without those already there."""
    path = f"{d.rstrip('/')}/merged_messages.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = spark.readStream.schema(schema)
    source = reader.parquet(path) if whole else reader.option("pathGlobFilter", "merged_messages.parquet").parquet(d)
    out = _folder(spark)
    append_new(link_ops.valid_urls(source, "message").select("url"), "url", f"{out}/urls", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/urls")


# URL parts


@query("ref_p7_norm_url", f"SELECT seq, {sql_norm('orig_url')} AS norm_url FROM url_mapping")
def p7(spark, d):
    return _mapping(spark, d).select("seq", urls.normalise_url(F.col("orig_url")).alias("norm_url"))


@query("ref_p7b_norm_url_legacy", f"SELECT seq, CASE WHEN {sql_strip('orig_url')} = '' THEN 'http://' ELSE {sql_strip('orig_url')} END AS norm_url FROM url_mapping")
def p7b(spark, d):
    return _mapping(spark, d).select("seq", urls.normalise_url(F.col("orig_url"), "legacy").alias("norm_url"))


@query("ref_p8_domain", f"SELECT seq, {sql_domain('u')} AS domain FROM (SELECT seq, {sql_norm('orig_url')} AS u FROM url_mapping WHERE orig_url IS NOT NULL)")
def p8(spark, d):
    return _mapping(spark, d).filter("orig_url is not null").select("seq", urls.registered_domain(urls.normalise_url(F.col("orig_url"))).alias("domain"))


@query("ref_p9_netloc", f"SELECT seq, {sql_netloc('orig_url')} AS netloc FROM url_mapping")
def p9(spark, d):
    return _mapping(spark, d).select("seq", urls.netloc(F.col("orig_url")).alias("netloc"))


@query("ref_p10_final_url", "SELECT seq, split_part(final_url, '?', 1) AS bare_url FROM url_mapping")
def p10(spark, d):
    return _mapping(spark, d).select("seq", urls.final_url(F.col("final_url")).alias("bare_url"))


@query("ref_p11_md5", "SELECT seq, md5(split_part(final_url, '?', 1)) AS page FROM url_mapping")
def p11(spark, d):
    return _mapping(spark, d).select("seq", F.md5(urls.final_url(F.col("final_url"))).alias("page"))


# Statuses


@query("f4_status", f"SELECT seq, lower({sql_strip('status')}) = 'mapped' AND status IS NOT NULL AS loose, coalesce(status = 'mapped', false) AS strict FROM url_mapping WHERE status IS NOT NULL")
def f4(spark, d):
    return _mapping(spark, d).filter("status is not null").select("seq", domains.is_mapped().alias("loose"), domains.is_mapped(strict=True).alias("strict"))


@query("a7_status_hist", f"SELECT lower({sql_strip('status')}) AS status, count(*) AS n FROM url_mapping GROUP BY 1")
def a7(spark, d):
    return _mapping(spark, d).groupBy(F.lower(strip(F.col("status"))).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("ref_p40_status_class", f"SELECT seq, regexp_extract(lower({sql_strip('status')}), '^[a-z]+', 0) AS class FROM url_mapping")
def p40(spark, d):
    return _mapping(spark, d).select("seq", status_class(F.col("status")).alias("class"))


STATED = f"""SELECT hash AS page, lower({sql_strip('status')}) AS s, seq FROM (SELECT hash, seq, CASE seq % 4 WHEN 1 THEN 'partial-server-html: cut' WHEN 2 THEN 'Partial-dom' WHEN 3 THEN 'partial-har-close' ELSE status END AS status FROM url_mapping) WHERE {sql_strip('status')} <> ''"""


@query("ref_p40_final_status", f"""WITH r AS ({STATED}),
 l AS (SELECT page, max(seq) AS last, max(seq) FILTER (starts_with(s, 'partial-server-html')) AS first, max(seq) FILTER (NOT starts_with(s, 'partial')) AS whole FROM r GROUP BY 1)
 SELECT l.page AS hash, r.s AS status FROM l JOIN r ON r.page IS NOT DISTINCT FROM l.page AND r.seq = CASE WHEN first IS NOT NULL AND coalesce(whole < first, true)
  AND (SELECT bool_or(starts_with(x.s, 'partial')) FROM r x WHERE x.seq = l.last) THEN first ELSE last END""")
def p40b(spark, d):
    """The status that a page keeps; three of four captures are made partial ones."""
    n = F.col("seq") % 4
    status = F.when(n == 1, "partial-server-html: cut").when(n == 2, "Partial-dom").when(n == 3, "partial-har-close").otherwise(F.col("status"))
    return final_status(_mapping(spark, d).withColumn("status", status), "hash", "status", "seq")


@query("ref_p38_pct", """WITH c AS (SELECT status, count(*) AS n FROM url_mapping GROUP BY 1)
SELECT status, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 2) AS pct FROM c""")
def p38(spark, d):
    counts = _mapping(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("status", "n", F.round(F.col("n") * F.lit(100.0) / F.col("t"), 2).alias("pct"))


@query("w5_crawl_status", """SELECT seq, CASE WHEN row_number() OVER (PARTITION BY md5(split_part(final_url, '?', 1)) ORDER BY seq) = 1
 THEN 'mapped' ELSE 'skipped' END AS crawl_status FROM url_mapping""")
def w5(spark, d):
    rows = _mapping(spark, d).select("seq", F.md5(urls.final_url(F.col("final_url"))).alias("page"))
    return dedupe.crawl_status(rows, "page", "seq").select("seq", "crawl_status")


# Domains and ranks

DOMAINS = f"SELECT {sql_domain('u')} AS domain FROM (SELECT {sql_norm('orig_url')} AS u FROM url_mapping WHERE orig_url IS NOT NULL)"


@query("a2_domain_summary", sql_top_n(DOMAINS, "domain"))
def a2(spark, d):
    return domains.top_n_with_others(domains.domain_table(_mapping(spark, d), "orig_url"), "domain")


@query("a2_netloc_summary", sql_top_n(f"SELECT {sql_netloc('final_url')} AS netloc FROM url_mapping", "netloc"))
def a2b(spark, d):
    return domains.top_n_with_others(_mapping(spark, d).select(urls.netloc(F.col("final_url")).alias("netloc")), "netloc")


@query("k9_chart_labels", f"SELECT *, printf('%.2f%%', percentage) AS label FROM ({sql_top_n(DOMAINS, 'domain')})")
def k9(spark, d):
    return domains.chart_table(domains.top_n_with_others(domains.domain_table(_mapping(spark, d), "orig_url"), "domain"), "domain")


@query("c2_message_domains", sql_top_n(f"SELECT {sql_domain('u')} AS domain FROM (SELECT {sql_norm('url')} AS u FROM ({FIRST_ROWS}))", "domain"))
def c2(spark, d):
    """From messages to the summary in one plan."""
    return domains.top_n_with_others(domains.domain_table(link_ops.extract_urls(_messages(spark, d), "message", "msg_id"), "url"), "domain")


@query("s7_rank_table", RANKS)
def s7(spark, d):
    return _ranks(spark, d)


@query("j1_rank_left", f"""SELECT seq, orig_url, n.netloc AS normalized_domain, tranco_rank
FROM (SELECT seq, orig_url, {sql_netloc('orig_url')} AS netloc FROM url_mapping) n LEFT JOIN ({RANKS}) r ON n.netloc = r.domain""")
def j1(spark, d):
    return domains.with_rank(_mapping(spark, d).select("seq", "orig_url"), "orig_url", _ranks(spark, d))


@query("j2_rank_distinct", f"""SELECT n.domain, tranco_rank FROM (SELECT DISTINCT {sql_netloc('final_url')} AS domain FROM url_mapping) n
LEFT JOIN ({RANKS}) r ON n.domain = r.domain WHERE n.domain <> '' ORDER BY 1""")
def j2(spark, d):
    return domains.ranked_domains(_mapping(spark, d), "final_url", _ranks(spark, d))


def _stem(c: str) -> str:
    return f"regexp_replace({c}, '\\.[^.]*$', '')"


SURVIVES = f"""({sql_strip('hash')} <> '' AND ({sql_strip('hash')} IN (SELECT {_stem('name')} FROM ({PAGES}))
 OR {sql_strip('hash')} IN (SELECT name FROM ({PAGES})) OR {_stem(sql_strip('hash'))} IN (SELECT {_stem('name')} FROM ({PAGES}))))"""
MAPPED = f"lower({sql_strip('status')}) = 'mapped'"


@query("j3_semi_or", f"SELECT seq, hash FROM url_mapping WHERE {SURVIVES}")
def j3(spark, d):
    return domains.keep_surviving(_mapping(spark, d), _page_files(spark, d), "seq").select("seq", "hash")


@query("j4_semi_exact", f"SELECT seq, hash FROM url_mapping WHERE status = 'mapped' AND hash || '.png' IN (SELECT name FROM ({PAGES}))")
def j4(spark, d):
    rows = _mapping(spark, d).filter(domains.is_mapped(strict=True)).select("seq", "hash", F.concat("hash", F.lit(".png")).alias("name"))
    return rows.join(_page_files(spark, d), "name", "left_semi").select("seq", "hash")


@query("c3_dedupe_summary", sql_top_n(f"SELECT {sql_domain('u')} AS domain FROM (SELECT {sql_norm('orig_url')} AS u FROM url_mapping WHERE orig_url IS NOT NULL AND {MAPPED} AND {SURVIVES})", "domain"))
def c3(spark, d):
    return domains.surviving_domain_summary(_mapping(spark, d), _page_files(spark, d), "seq")


@query("j5_resume_anti", """SELECT seq, hash FROM url_mapping m WHERE NOT EXISTS (SELECT 1 FROM har_captures c WHERE c.hash = m.hash)
 AND NOT EXISTS (SELECT 1 FROM documents p WHERE p.page_hash = m.hash)""")
def j5(spark, d):
    done = table(spark, d, "har_captures").select("hash"), table(spark, d, "documents").select("page_hash")
    return dedupe.not_done(_mapping(spark, d).select("seq", "hash"), "hash", *done)


@query("u4_difference", "SELECT hash FROM url_mapping WHERE hash IS NOT NULL EXCEPT SELECT hash FROM har_responses")
def u4(spark, d):
    return _mapping(spark, d).select("hash").filter("hash is not null").subtract(table(spark, d, "har_responses").select("hash"))


@query("u5_intersection", "SELECT hash FROM url_mapping INTERSECT SELECT hash FROM har_responses WHERE hash IS NOT NULL")
def u5(spark, d):
    return _mapping(spark, d).select("hash").intersect(table(spark, d, "har_responses").select("hash").filter("hash is not null"))


@query("j6_route", f"""WITH r AS (SELECT page_hash || '.txt' AS log_name, CASE WHEN contains(text, '@') THEN 'Y,{{user''s email address}}' ELSE 'N,{{}}' END AS result
 FROM documents WHERE page_hash IS NOT NULL)
SELECT regexp_replace(log_name, '\\.txt$', '.png') AS file_name, CASE WHEN starts_with(result, 'Y') THEN 'pii' ELSE 'no_pii' END AS bucket,
 regexp_replace(log_name, '\\.txt$', '.png') NOT IN (SELECT name FROM ({PAGES})) AS missing FROM r""")
def j6(spark, d):
    docs = table(spark, d, "documents").filter("page_hash is not null")
    said = F.when(F.col("text").contains("@"), "Y,{user's email address}").otherwise("N,{}")
    return classify.route(docs.select(F.concat("page_hash", F.lit(".txt")).alias("log_name"), said.alias("result")), _page_files(spark, d), "log_name")


ARTIFACT_NAMES = """SELECT hash || '.har' AS name FROM har_captures UNION ALL
 SELECT page_hash || CASE source WHEN 'server_html' THEN '.server.html' ELSE '.dom.html' END FROM documents WHERE source IN ('server_html', 'dom_html')"""
STEMS = f"""SELECT regexp_extract(name, '^(.*?)(\\.har|\\.server\\.html|\\.dom\\.html)$', 1) AS stem,
 regexp_extract(name, '^(.*?)(\\.har|\\.server\\.html|\\.dom\\.html)$', 2) AS suffix FROM ({ARTIFACT_NAMES})"""


def _artifacts(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("source").isin("server_html", "dom_html"))
    suffix = F.when(F.col("source") == "server_html", ".server.html").otherwise(".dom.html")
    return table(spark, d, "har_captures").select(F.concat("hash", F.lit(".har")).alias("name")).unionAll(docs.select(F.concat("page_hash", suffix)))


@query("s10_stem_union", f"SELECT stem, count(DISTINCT suffix) AS n FROM ({STEMS}) WHERE stem <> '' GROUP BY 1 ORDER BY 1")
def s10(spark, d):
    return files.artifact_stems(_artifacts(spark, d))


@query("j7_complete_artifacts", f"SELECT seq, hash FROM url_mapping WHERE hash IS NULL OR hash NOT IN (SELECT stem FROM ({STEMS}) WHERE stem <> '' GROUP BY 1 HAVING count(DISTINCT suffix) = 3)")
def j7(spark, d):
    """Mapping rows whose page lacks one of its three artifacts."""
    return dedupe.not_done(_mapping(spark, d).select("seq", "hash"), "hash", files.artifact_stems(_artifacts(spark, d)).filter("n = 3").select("stem"))


@query("s5_resolve_columns", "SELECT orig_url, hash, status FROM url_mapping")
def s5(spark, d):
    unnamed = _mapping(spark, d).select(F.col("orig_url").alias("a"), F.col("final_url").alias("b"), F.col("hash").alias("c"), F.col("status").alias("d"))
    return files.resolve_columns(unnamed)


@query("s6_text_lines", f"SELECT msg_id, line AS value FROM (SELECT msg_id, {sql_strip('unnest(string_split(message, chr(10)))')} AS line FROM merged_messages) WHERE line <> ''")
def s6(spark, d):
    rows = _messages(spark, d).select("msg_id", F.explode(F.split("message", "\n")).alias("value"))
    return rows.select("msg_id", strip(F.col("value")).alias("value")).filter("value <> ''")


@query("s9_file_stems", f"SELECT name, {_stem('name')} AS stem FROM ({PAGES})")
def s9(spark, d):
    return files.with_names(_page_files(spark, d).withColumnRenamed("name", "path")).select("name", "stem")


@query("k8_destinations", """SELECT path, dest_name, count(*) OVER (PARTITION BY dest_name) AS n_same, path = max(path) OVER (PARTITION BY dest_name) AS wins
 FROM (SELECT DISTINCT source || '/' || page_hash || '.png' AS path, page_hash || '.png' AS dest_name FROM documents WHERE page_hash IS NOT NULL)""")
def k8(spark, d):
    rows = table(spark, d, "documents").filter("page_hash is not null").select(F.concat("source", F.lit("/"), "page_hash", F.lit(".png")).alias("path")).distinct()
    return files.with_destination(rows)


@query("s14_required_columns", "SELECT page_hash AS image_name, coalesce(text, '') AS extracted_text FROM documents WHERE trim(page_hash) <> ''")
def s14(spark, d):
    rows = table(spark, d, "documents").select(F.col("page_hash").alias("image_name"), F.col("text").alias("extracted_text"))
    return files.require_columns(rows, "image_name", "extracted_text")


@query("u1_union_all", """SELECT CAST(seq AS VARCHAR) AS seq, orig_url FROM url_mapping UNION ALL SELECT CAST(msg_id AS VARCHAR), to_number FROM merged_messages
 UNION ALL SELECT CAST(site_rank AS VARCHAR), domain FROM tranco_list""")
def u1(spark, d):
    return dedupe.union_by_position(_mapping(spark, d).select("seq", "orig_url"), _messages(spark, d), table(spark, d, "tranco_list"))


@query("s3_csv_named", "SELECT coalesce(to_number, '') AS to_number, coalesce(message, '') AS message, '' AS absent FROM merged_messages")
def s3(spark, d):
    """Messages written as CSV and read back by name; a column that isn't there is empty."""
    path = _folder(spark)
    files.write_csv(_messages(spark, d), path)
    return files.read_csv(spark, path, ["to_number", "message", "absent"])


@query("s4_csv_positional", "SELECT message FROM merged_messages WHERE message <> ''")
def s4(spark, d):
    path = _folder(spark)
    files.write_csv(_messages(spark, d), path)
    return files.by_position(files.read_csv(spark, path), 4, "message").filter("message <> ''")


@query("s11_mapping_scan", "SELECT orig_url, final_url, coalesce(hash, '') AS hash, coalesce(status, '') AS status FROM url_mapping")
def s11(spark, d):
    """The mapping written with every field quoted, and read back by its row pattern."""
    path = _folder(spark)
    rows = _mapping(spark, d).select([F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("orig_url", "final_url", "hash", "status")])
    files.write_csv(rows, path, quote_all=True)
    return files.read_mapping(spark, path)


@query("k3_append_csv", "SELECT CAST(seq AS VARCHAR) AS seq, coalesce(status, '') AS status FROM url_mapping")
def k3(spark, d):
    """Results appended to CSV text in two runs; the header is written once."""
    path = _folder(spark)
    rows = _mapping(spark, d).select(F.col("seq").cast("string").alias("seq"), "status")
    for later in (False, True):
        files.append_csv(rows.filter((F.col("seq") % 2 == 1) == F.lit(later)), path)
    return files.read_appended(spark, path).select("seq", F.coalesce("status", F.lit("")).alias("status"))


@query("k2_sorted_lines", f"SELECT DISTINCT url AS value FROM ({VALID_ROWS})")
def k2(spark, d):
    """Distinct links written one a line, in order, and read back."""
    path = _folder(spark)
    files.write_sorted_lines(link_ops.valid_urls(_messages(spark, d), "message"), "url", path)
    return spark.read.text(path)


@query("k5_per_key", "SELECT hash, count(*) AS n FROM har_responses WHERE hash IS NOT NULL GROUP BY 1")
def k5(spark, d):
    """Responses written by page into buckets, and counted there."""
    path = _folder(spark)
    files.write_per_key(table(spark, d, "har_responses").select("hash", "entry_id").filter("hash is not null"), "hash", path, buckets=16)
    return spark.read.parquet(path).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


@query("k4_jsonl", "SELECT msg_id, message FROM merged_messages")
def k4(spark, d):
    path = _folder(spark)
    files.write_jsonl(_messages(spark, d).select("msg_id", "message"), path)
    return spark.read.schema("msg_id bigint, message string").json(path)


@query("ref_p13_has_alpha", "SELECT msg_id, coalesce(regexp_matches(message, '\\p{L}'), false) AS alpha FROM merged_messages")
def p13(spark, d):
    return _messages(spark, d).select("msg_id", has_alpha(F.col("message")).alias("alpha"))
