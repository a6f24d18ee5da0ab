import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.operators import nested
from tracewell.operators.nested import HarTables

E = {"response": {"headers": [{"name": "A", "value": "1"}, None, {"name": ""}, {"name": "B", "value": 2}, {"value": "x"}], "content": {"text": "hi", "size": 2, "mimeType": "text/plain"}}}
FILES = [
    (1, json.dumps({"log": {"entries": [E, None, {}, {"response": None}, {"response": {"headers": {"X": "1", "": "2", "Y": 3}}}, {"response": {"headers": []}}]}})),
    (2, '{"log": {"entries": []}}'), (3, "{}"), (4, '{"log": null}'), (5, '{"log": {"entries": [{"resp'), (6, None), (7, "  "), (8, ""), (9, "[]"), (10, '{"a": NaN}'), (11, '{"log": {"entries": null}} x'), (12, '{"log": {"entries": {}}}'),
]


@pytest.fixture(scope="module")
def har(spark):
    # extra columns with clashing names aren't read
    df = spark.createDataFrame([(k, h, "x", "y") for k, h in FILES], "capture_id bigint, har string, dewey string, schema_path string")
    return HarTables(df)


def test_header_rows(har):
    got = {tuple(r) for r in har.header_rows().collect()}
    one = {(1, 1, 1), (1, 1, 4), (1, 2, 0), (1, 3, 0), (1, 4, 0), (1, 5, 1), (1, 5, 3), (1, 6, 0)}
    assert got == one | {(k, 0, 0) for k in (2, 3, 4, 9, 12)}
    assert har.header_rows().count() == len(got)


def test_links(har):
    entries = {r.dewey: r for r in har.entries().collect()}
    captures = {(r.capture_id, r.dewey) for r in har.captures().collect()}
    assert len(captures) == 6 and len(entries) == 6
    assert all((r.capture_id, r.parent) in captures for r in entries.values())
    contents = har.contents().collect()
    assert [(r.entry_no, r.text, r.size) for r in contents] == [(1, "hi", 2)] and contents[0].parent in entries
    headers = har.headers().collect()
    assert all(r.parent in entries for r in headers)
    assert {(r.entry_no, r.header_no, r.name, r.value) for r in headers if r.name} == {(1, 1, "A", "1"), (1, 4, "B", "2"), (5, 1, "X", "1"), (5, 3, "Y", "3")}


def test_empty_table(spark):
    assert HarTables(spark.createDataFrame([], "capture_id bigint, har string")).header_rows().count() == 0


tree = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab", max_size=3), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text("xy", min_size=1, max_size=2), c, max_size=4), max_leaves=25)


@settings(max_examples=60, deadline=None)
@given(tree)
def test_labels_are_ways(value):
    """Every node of arrays of arrays is found, and its label leads back to it."""
    want = nested._Wanted()
    for n in range(1, 5):
        want.add(["[]"] * n)
    found = list(nested._walk(value, want, "$", "1"))

    def count(v, depth):
        return 0 if depth == 0 or not isinstance(v, list) else len(v) + sum(count(x, depth - 1) for x in v)

    assert len(found) == count(value, 4) == len({f[1] for f in found})
    assert [f[1] for f in found] == sorted(f[1] for f in found)
    for path, label, kind, _, _ in found:
        at = value
        for n in label.split(".")[1:]:
            at = at[int(n) - 1]
        assert nested._kind(at) == kind and path == "$" + "[]" * (label.count("."))
