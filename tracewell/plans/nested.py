"""Queries over nested captures (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.io import table
from tracewell.operators.nested import HarTables
from tracewell.plans.registry import Registry

query = Registry()

#: Headers by JSON functions, entry by entry and header by header.
FOUND_SQL = """
WITH v AS (SELECT capture_id, CAST(har AS JSON) AS j FROM har_captures WHERE json_valid(har) AND trim(har) <> ''),
e AS (SELECT capture_id, j, CASE WHEN json_type(j, '$.log.entries') = 'ARRAY' THEN json_array_length(j, '$.log.entries') ELSE 0 END AS n FROM v),
x AS (SELECT capture_id, CAST(i + 1 AS INTEGER) AS entry_no, json_extract(j, '$.log.entries[' || i || '].response.headers') AS h FROM (SELECT capture_id, j, unnest(range(CAST(n AS BIGINT))) AS i FROM e)),
l AS (SELECT capture_id, entry_no, CAST(k + 1 AS INTEGER) AS header_no, json_extract_string(h, '$[' || k || '].name') AS name FROM (SELECT *, unnest(range(CAST(json_array_length(h) AS BIGINT))) AS k FROM x WHERE json_type(h) = 'ARRAY')),
m AS (SELECT capture_id, entry_no, CAST(unnest(range(len(ks))) + 1 AS INTEGER) AS header_no, unnest(ks) AS name FROM (SELECT *, json_keys(h) AS ks FROM x WHERE json_type(h) = 'OBJECT')),
named AS (SELECT capture_id, entry_no, header_no FROM l WHERE name <> '' UNION ALL SELECT capture_id, entry_no, header_no FROM m WHERE name <> '')
SELECT * FROM named
UNION ALL SELECT capture_id, entry_no, 0 FROM x WHERE NOT EXISTS (SELECT 1 FROM named y WHERE y.capture_id = x.capture_id AND y.entry_no = x.entry_no)
UNION ALL SELECT capture_id, 0, 0 FROM e WHERE n = 0
"""


def _har(spark: SparkSession, sf_dir: str) -> HarTables:
    return HarTables(table(spark, sf_dir, "har_captures"))


@query("p2_found", FOUND_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture_id, entry_no, header_no) of the named headers, with rows for entries and files without any."""
    return _har(spark, sf_dir).header_rows()


@query("p2_captures", "SELECT capture_id, '1' AS dewey, lower(json_type(CAST(har AS JSON))) AS top_kind FROM har_captures WHERE json_valid(har) AND trim(har) <> ''")
def p2_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _har(spark, sf_dir).captures()


ENTRIES_SQL = """WITH v AS (SELECT capture_id, CAST(har AS JSON) AS j FROM har_captures WHERE json_valid(har) AND trim(har) <> ''),
 e AS (SELECT capture_id, unnest(range(CAST(json_array_length(j, '$.log.entries') AS BIGINT))) AS i, j, list_position(json_keys(j), 'log') AS p, list_position(json_keys(j, '$.log'), 'entries') AS q FROM v WHERE json_type(j, '$.log.entries') = 'ARRAY'),
 x AS (SELECT capture_id, CAST(i + 1 AS INTEGER) AS entry_no, json_extract(j, '$.log.entries[' || i || ']') AS x, '1.' || lpad(p::VARCHAR, 10, '0') || '.' || lpad(q::VARCHAR, 10, '0') || '.' || lpad((i + 1)::VARCHAR, 10, '0') AS dewey FROM e)"""


@query("p2_entries", f"""{ENTRIES_SQL} SELECT capture_id, entry_no, dewey, '1' AS parent, CASE json_type(x) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' ELSE lower(json_type(x)) END AS entry_kind,
 json_extract_string(x, '$.startedDateTime') AS started FROM x""")
def p2_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _har(spark, sf_dir).entries()


@query("p2_contents", f"""{ENTRIES_SQL}, c AS (SELECT *, json_extract(x, '$.response.content') AS c, list_position(json_keys(x), 'response') AS p, list_position(json_keys(x, '$.response'), 'content') AS q FROM x)
 SELECT capture_id, entry_no, dewey || '.' || lpad(p::VARCHAR, 10, '0') || '.' || lpad(q::VARCHAR, 10, '0') AS dewey, dewey AS parent, json_extract_string(c, '$.text') AS text, json_extract_string(c, '$.encoding') AS encoding,
 json_extract_string(c, '$.mimeType') AS mimetype, TRY_CAST(json_extract_string(c, '$.size') AS BIGINT) AS size FROM c WHERE json_type(c) = 'OBJECT'""")
def p2_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _har(spark, sf_dir).contents()


@query("p2_headers", f"""{ENTRIES_SQL}, h AS (SELECT *, json_extract(x, '$.response.headers') AS h, dewey || '.' || lpad(list_position(json_keys(x), 'response')::VARCHAR, 10, '0') || '.' || lpad(list_position(json_keys(x, '$.response'), 'headers')::VARCHAR, 10, '0') AS d FROM x),
 l AS (SELECT capture_id, entry_no, dewey, d, k, json_extract(h, '$[' || k || ']') AS y FROM (SELECT *, unnest(range(CAST(json_array_length(h) AS BIGINT))) AS k FROM h WHERE json_type(h) = 'ARRAY')),
 m AS (SELECT capture_id, entry_no, dewey, d, k, name, json_extract(h, '$."' || name || '"') AS v FROM (SELECT *, unnest(range(len(json_keys(h)))) AS k, unnest(json_keys(h)) AS name FROM h WHERE json_type(h) = 'OBJECT'))
 SELECT capture_id, entry_no, CAST(k + 1 AS INTEGER) AS header_no, d || '.' || lpad((k + 1)::VARCHAR, 10, '0') AS dewey, dewey AS parent, json_extract_string(y, '$.name') AS name, json_extract_string(y, '$.value') AS value FROM l
 UNION ALL SELECT capture_id, entry_no, CAST(k + 1 AS INTEGER), d || '.' || lpad((k + 1)::VARCHAR, 10, '0'), dewey, name, CASE WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(v, '$') END FROM m""")
def p2_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _har(spark, sf_dir).headers()
