"""Queries over texts, labels and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.functions.body import body
from tracewell.functions.language import detect_language
from tracewell.io import table
from tracewell.operators import classify, dedupe, labels
from tracewell.plans.links import sql_strip
from tracewell.plans.registry import Registry
from tracewell.sources import files

query = Registry()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("ref_p14_lang_detect")
def p14(spark, d):
    """Each document's language by n-gram profiles."""
    return _docs(spark, d).select("doc_id", detect_language(F.col("text")).alias("lang"))


@query("a1_lang_hist", "SELECT lang, count(*) AS messages FROM documents WHERE lang IS NOT NULL AND regexp_matches(text, '\\p{L}') GROUP BY 1")
def a1(spark, d):
    rows = _docs(spark, d).filter(tx.has_alpha(F.col("text")) & F.col("lang").isNotNull())
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("messages"))


@query("a1_lang_hist_detected")
def a1b(spark, d):
    """Messages by the detected language."""
    rows = table(spark, d, "merged_messages").filter(tx.has_alpha(F.col("message"))).select(detect_language(F.col("message")).alias("lang"))
    return rows.filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("messages"))


@query("ref_p12_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def p12(spark, d):
    return _docs(spark, d).filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


CHUNKS_SQL = """SELECT entry_id, CAST(i + 1 AS INTEGER) AS chunk_index, CAST(i * 49950 AS INTEGER) AS start, CAST(length(c) AS INTEGER) AS chars, md5(c) AS digest FROM (
 SELECT entry_id, i, substring(text, i * 49950 + 1, 50000) AS c FROM (SELECT entry_id, text,
 unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 50000 THEN 1 ELSE (greatest(length(text) - 51, 0) // 49950) + 1 END)) AS i
 FROM har_responses WHERE text IS NOT NULL))"""


@query("ref_p28_chunks", CHUNKS_SQL)
def p28(spark, d):
    rows = classify.chunks(table(spark, d, "har_responses"), "entry_id", "text")
    return rows.select("entry_id", "chunk_index", "start", "chars", F.md5("chunk").alias("digest"))


@query("ref_p29_truncate", f"SELECT doc_id, md5(left({sql_strip('text')}, 25000)) AS digest FROM documents WHERE text IS NOT NULL")
def p29(spark, d):
    return _docs(spark, d).filter("text is not null").select("doc_id", F.md5(tx.truncate(F.col("text"))).alias("digest"))


HEAD, TAIL = classify.TEMPLATE.replace("{labels}", ", ".join(labels.PII_TYPES)).replace("{{", "{").replace("}}", "}").replace("'", "''").split("{text}")


@query("ref_p30_prompt", f"SELECT doc_id, md5('{HEAD}' || left({sql_strip('coalesce(text, chr(32))')}, 25000) || '{TAIL}') AS digest FROM documents")
def p30(spark, d):
    return classify.prompts(_docs(spark, d), "doc_id", "text", most=25_000).select("doc_id", F.md5("prompt").alias("digest"))


WORDS_SQL = "list_filter(string_split_regex(text, '[" + tx.SPACE + "]+'), lambda w: w <> '')"


@query("ref_p36_dedup_words", f"""WITH w AS (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS i FROM (SELECT doc_id, {WORDS_SQL} AS l FROM documents WHERE text IS NOT NULL)),
 f AS (SELECT doc_id, arg_min(w, i) AS w, min(i) AS i FROM w GROUP BY doc_id, lower(w)), g AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY 1)
 SELECT doc_id, md5(coalesce(words, '')) AS digest FROM documents LEFT JOIN g USING (doc_id) WHERE text IS NOT NULL""")
def p36(spark, d):
    """Each document's words once, in order."""
    return _docs(spark, d).filter("text is not null").select("doc_id", F.md5(tx.dedupe_words(F.col("text"))).alias("digest"))


@query("ref_p36_part_words", """SELECT p_partkey, array_to_string([x.w FOR x IN list_sort(
 [{'i': i, 'w': l[i]} FOR i IN range(1, len(l) + 1) IF NOT list_contains([lower(y) FOR y IN l[1:i - 1]], lower(l[i]))])], ' ') AS words
 FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || upper(p_name), ' ') AS l FROM part)""")
def p36b(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", F.upper("p_name")).alias("t"))
    return rows.select("p_partkey", tx.dedupe_words(F.col("t")).alias("words"))


@query("ref_p37_preview", "SELECT doc_id, CASE WHEN length(text) > 160 THEN left(text, 160) || '...' ELSE text END AS preview FROM documents")
def p37(spark, d):
    return _docs(spark, d).select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("ref_p34_scripts", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{r}') THEN '{n}' END" for n, r in tx.SCRIPTS) + "], lambda x: x IS NOT NULL), ',') AS scripts FROM documents")
def p34(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(tx.scripts(F.col("text")), ",").alias("scripts"))


@query("ref_p35_utility", "SELECT doc_id, round(0.9 * ln(1 + length(text)), 6) AS utility FROM documents")
def p35(spark, d):
    return _docs(spark, d).select("doc_id", F.round(tx.utility(F.lit(0.9), F.col("text")), 6).alias("utility"))


@query("ref_p25_words", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' '))), ' ') AS words FROM part")
def p25(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(tx.words(labels.similarity_form(F.col("p_type")))), " ").alias("words"))


@query("ref_p24_simplify", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '"' || lower(o_orderpriority) || '"' WHEN 1 THEN lower(o_orderpriority) || ' a' ELSE lower(o_orderpriority) || ' b c' END AS simple FROM orders""")
def p24(spark, d):
    """Order priorities in braces, quotes, wide letters and with asides: quotes go only where they enclose the whole."""
    p, k = F.col("o_orderpriority"), F.col("o_orderkey") % 3
    said = F.when(k == 0, F.concat(F.lit("{“"), p, F.lit("” (x)}"))).when(k == 1, F.concat(F.lit("{'"), p, F.lit("  (x) Ａ '}"))).otherwise(F.concat(F.lit(" "), p, F.lit(" {b}\u00a0(y)C ")))
    return table(spark, d, "orders").select("o_orderkey", labels.simplify(said).alias("simple"))


@query("ref_p26_jaccard", """SELECT p_partkey, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) ELSE 0.0 END AS jaccard
 FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || split_part(p_name, ' ', 1)), ' ')) AS b FROM part)""")
def p26(spark, d):
    a = F.array_distinct(F.split(F.lower("p_name"), " "))
    b = F.array_distinct(F.split(F.lower(F.concat("p_type", F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1)))), " "))
    return table(spark, d, "part").select("p_partkey", tx.jaccard(a, b).alias("jaccard"))


@query("w2_content_dedupe", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS survivor, doc_id > min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents")
def w2(spark, d):
    return dedupe.content_duplicates(_docs(spark, d), "doc_id", "text").select("doc_id", "survivor", "is_duplicate")


@query("w7_ordered_distinct", "SELECT lang, min(doc_id) AS ord FROM documents GROUP BY 1")
def w7(spark, d):
    return dedupe.ordered_distinct(_docs(spark, d).select("lang", "doc_id"), "lang", "doc_id")


# Numbered logs, keywords, clusters


@query("s13_numbered_payloads", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE source = 'har_json'),
 h AS (SELECT *, regexp_matches(line, '^[ \\t]*[0-9]+[ \\t]*\\[[^\\]]+\\]') AS head FROM l),
 g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS item FROM h),
 t AS (SELECT doc_id, item, string_agg(line, chr(10) ORDER BY i) AS body FROM g WHERE item > 0 GROUP BY 1, 2)
 SELECT doc_id, CAST(item AS INTEGER) AS item_no, regexp_extract(body, '^[ \\t]*[0-9]+[ \\t]*\\[\\s*([^\\]]+?)\\s*\\]', 1) AS origin,
 md5({sql_strip("regexp_replace(body, '^[ \\t]*[0-9]+[ \\t]*\\[[^\\]]+\\]', '')")}) AS digest FROM t
 WHERE {sql_strip("regexp_replace(body, '^[ \\t]*[0-9]+[ \\t]*\\[[^\\]]+\\]', '')")} <> ''""")
def s13(spark, d):
    rows = files.numbered_payloads(_docs(spark, d).filter("source = 'har_json'"), "doc_id", "text")
    return rows.select("doc_id", "item_no", "origin", F.md5("payload").alias("digest"))


@query("s15_keywords", "SELECT p_brand, keyword, min(ord) AS ord FROM (SELECT p_brand, unnest(l) AS keyword, CAST(unnest(range(len(l))) AS INTEGER) AS ord FROM (SELECT DISTINCT p_brand, string_split(p_type || ',' || p_brand || ',' || p_type, ',') AS l FROM part)) GROUP BY ALL")
def s15(spark, d):
    """Keyword lists made of part types and brands."""
    rows = table(spark, d, "part").select("p_brand", F.concat_ws(",", "p_type", "p_brand", "p_type").alias("value")).distinct()
    return files.keywords(rows, "value", ["p_brand"])


CLUSTER_TEXT = "SELECT r_regionkey, '## ' || r_name || chr(10) || string_agg('- ' || n_name, chr(10) ORDER BY n_nationkey) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"


def _cluster_text(spark, d) -> DataFrame:
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = both.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    return lists.select(F.concat(F.lit("## "), "r_name", F.lit("\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["n_name"])), "\n")).alias("value"))


@query("s16_clusters", "SELECT r_name AS category, n_name AS keyword FROM nation JOIN region ON n_regionkey = r_regionkey")
def s16(spark, d):
    return files.clusters(_cluster_text(spark, d)).select("category", "keyword")


@query("a8_lexicon_audit", """WITH c AS (SELECT n_name AS keyword, count(*) AS n FROM nation GROUP BY 1), a AS (SELECT DISTINCT upper(p_brand) AS keyword FROM part UNION SELECT n_name FROM nation WHERE n_regionkey <> 1)
 SELECT 'missing' AS issue, keyword, 0::BIGINT AS n FROM a WHERE keyword NOT IN (SELECT keyword FROM c)
 UNION ALL SELECT 'extra', keyword, n FROM c WHERE keyword NOT IN (SELECT keyword FROM a) UNION ALL SELECT 'repeated', keyword, n FROM c WHERE n > 1""")
def a8(spark, d):
    """Nations and brands as the lexicon, the regions' nations as clusters: one region's nations are extra."""
    lexicon = table(spark, d, "part").select(F.upper("p_brand").alias("keyword")).union(table(spark, d, "nation").filter("n_regionkey <> 1").select("n_name"))
    return labels.lexicon_audit(lexicon, files.clusters(_cluster_text(spark, d)))


# Labels and answers

N = len(labels.PII_TYPES)
LABELS_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in labels.PII_TYPES) + "]"


def _label(c):
    return F.element_at(F.array(*map(F.lit, labels.PII_TYPES)), (c % N + 1).cast("int"))


def _answers(spark, d) -> DataFrame:
    """An answer made up for each order: two labels, one in another spelling, none, none with labels, and no answer."""
    k = F.col("o_orderkey")
    kind = k % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit("Y,{"), _label(k), F.lit(" (x1),"), _label(k + 7), F.lit("}"))).when(kind == 1, "N,{}")
        .when(kind == 2, F.concat(F.lit(" y , {“"), F.upper(_label(k)), F.lit("”}"))).when(kind == 3, F.concat(F.lit("N,{"), _label(k), F.lit("}")))
        .when(kind == 4, "Y").otherwise("  ")
    )
    return table(spark, d, "orders").select(k, raw.alias("raw"))


ANSWERS_SQL = f"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Y,{{' || {LABELS_SQL}[o_orderkey % {N} + 1] || ',' || {LABELS_SQL}[(o_orderkey + 7) % {N} + 1] || '}}'
 WHEN 2 THEN 'Y,{{' || {LABELS_SQL}[o_orderkey % {N} + 1] || '}}' ELSE 'N,{{}}' END AS result,
 CASE o_orderkey % 6 WHEN 4 THEN 'no_match' WHEN 5 THEN 'empty' ELSE 'parsed' END AS parse_status FROM orders"""


@query("j8_label_exact", f"SELECT o_orderkey, {LABELS_SQL}[o_orderkey % {N} + 1] AS label FROM orders")
def j8(spark, d):
    k = F.col("o_orderkey")
    said = F.when(k % 2 == 0, F.concat(F.lit(" "), F.upper(_label(k)), F.lit(","))).otherwise(F.concat(F.lit("{‘"), F.initcap(_label(k)), F.lit("’}")))
    return table(spark, d, "orders").select(k, labels.exact_label(said).alias("label"))


def _tokens(spark, d) -> DataFrame:
    """Labels without their first word, with one word misspelt."""
    said = F.regexp_replace(_label(F.col("o_orderkey")), "^user's ", "")
    return table(spark, d, "orders").select(F.regexp_replace(said, "number", "numbr").alias("token"))


@query("j9_label_fuzzy")
def j9(spark, d):
    """Fuzzy labels of misspelt tokens."""
    return labels.fuzzy_matches(_tokens(spark, d), "token")


@query("ref_p27_similarity")
def p27(spark, d):
    return labels.similarities(_tokens(spark, d), "token")


@query("c5_normalize_answer", ANSWERS_SQL)
def c5(spark, d):
    return labels.normalise_answers(_answers(spark, d), "o_orderkey", "raw").select("o_orderkey", "result", "parse_status")


def _lines(spark, d) -> DataFrame:
    """Order lines as chunk rows: the chunk is the line, its categories the mode of flags."""
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("chunk_index"), F.array("l_returnflag", "l_linestatus").alias("categories"))


@query("a5_chunk_union", """WITH f AS (SELECT l_orderkey, v, min(ord) AS o FROM (SELECT l_orderkey, l_linenumber * 10 AS ord, l_returnflag AS v FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber * 10 + 1, l_linestatus FROM lineitem) GROUP BY 1, 2)
 SELECT l_orderkey, 'Y,{' || string_agg(v, ',' ORDER BY o, v) || '}' AS result FROM f GROUP BY 1""")
def a5(spark, d):
    return classify.union_of_chunks(_lines(spark, d), "l_orderkey", "chunk_index", "categories").select("l_orderkey", "result")


@query("a6_chunk_meta", "SELECT l_orderkey, CAST(count(*) AS INTEGER) AS num_chunks, string_agg(l_linenumber || ':' || l_linestatus, ',' ORDER BY l_linenumber, CAST(l_quantity AS INTEGER), l_linestatus) AS outputs FROM lineitem GROUP BY 1")
def a6(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("chunk_index"), F.col("l_quantity").cast("int").alias("chars"), F.col("l_linestatus").alias("parse_status"), F.lit("").alias("raw"))
    meta = classify.chunk_meta(rows, "l_orderkey")
    return meta.select("l_orderkey", "num_chunks", F.array_join(F.transform("chunk_outputs", lambda x: F.concat_ws(":", x["chunk_index"].cast("string"), x["parse_status"])), ",").alias("outputs"))


RULES_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(t, ''), '{r}') THEN '{x.replace(chr(39), chr(39) * 2)}' END" for x, r in classify.RULES) + "], lambda x: x IS NOT NULL), ',')"


RULE_LABELS = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x, _ in classify.RULES) + "]"


@query("c6_classify_ocr", f"""SELECT doc_id, CASE WHEN labels = '' THEN 'N,{{}}' ELSE 'Y,{{' || labels || '}}' END AS result, 'parsed' AS parse_status FROM (
 SELECT doc_id, {RULES_SQL} AS labels FROM (SELECT doc_id, left({sql_strip('text')}, 25000) AS t FROM documents))""")
def c6(spark, d):
    """Documents classified by the rule model."""
    return classify.classify_texts(_docs(spark, d), "doc_id", "text", classify.rules("doc_id")).select("doc_id", "result", "parse_status")


@query("c7_classify_logs", f"""WITH done AS (SELECT hash FROM har_captures WHERE hash IS NOT NULL), t AS (SELECT entry_id, text FROM har_responses
 WHERE {sql_strip('text')} <> '' AND (hash IS NULL OR hash NOT IN (SELECT hash FROM done))),
 c AS (SELECT entry_id, n, i, {sql_strip('substring(text, i * 49950 + 1, 50000)')} AS t FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT entry_id, text,
 CASE WHEN length(text) <= 50000 THEN 1 ELSE ((length(text) - 51) // 49950) + 1 END AS n FROM t))),
 r AS (SELECT entry_id, n, i, unnest(CASE WHEN labels = '' THEN [NULL] ELSE string_split(labels, ',') END) AS label FROM (SELECT *, {RULES_SQL} AS labels FROM c)),
 f AS (SELECT entry_id, n, label, min(i) AS i FROM r GROUP BY 1, 2, 3)
 SELECT entry_id, n > 1 AS chunked, CAST(n AS INTEGER) AS num_chunks, CASE WHEN count(label) = 0 THEN 'N,{{}}' ELSE 'Y,{{' || string_agg(label, ',' ORDER BY i, list_position({RULE_LABELS}, label)) || '}}' END AS result FROM f GROUP BY 1, 2, 3""")
def c7(spark, d):
    """Response texts of pages without a later capture, by the rule model; long ones chunk by chunk."""
    return _logs(table(spark, d, "har_responses").select("entry_id", "hash", "text"), spark, d)


def _logs(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    todo = dedupe.not_done(rows, "hash", table(spark, d, "har_captures").select("hash"))
    return classify.classify_logs(todo, "entry_id", "text", classify.rules).select("entry_id", "chunked", "num_chunks", "result")


@query("c7_classify_logs_decoded")
def c7b(spark, d):
    """As c7_classify_logs, of decoded bodies."""
    rows = table(spark, d, "har_responses")
    return _logs(rows.select("entry_id", "hash", body(F.col("text"), F.col("encoding"), F.col("mimetype")).alias("text")), spark, d)
