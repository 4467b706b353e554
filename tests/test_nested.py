from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from changegraph.operators import nested
from changegraph.operators.nested import NodeType, label, link, nesting, node_table, parse, rejected, trie
from changegraph.plans.dealt import FACTS

TYPES = [NodeType("flow", ("map", "*"), name=("id",), holds="object"), NodeType("step", ("map", "*", "steps", "*"), name=("key",), holds="object"), NodeType("end", ("map", "*", "steps", "*", "endpoints", "*"), holds="scalar")]


def table(spark, rows):
    return spark.createDataFrame(rows, "rec_no long, facts string, node_type string")


def linked(spark, rows, types=TYPES, chain=("flow", "step", "end")):
    got = link(node_table(table(spark, rows), ["rec_no"], "facts", types), ["rec_no"], list(chain))
    return sorted((r["rec_no"], r["flow_name"], r["step_name"], r[f"{chain[-1]}_value"]) for r in got.collect() if r[f"{chain[-1]}_value"] is not None)


def test_intervals_contain_exactly_the_descendants():
    record = {"a": [1, {"b": [2, 3]}, []], "c": {"d": {}, "e": None}}
    rows = label(record, trie([NodeType("x", ("*",)), NodeType("x", ("*", "*")), NodeType("x", ("*", "*", "*")), NodeType("x", ("*", "*", "*", "*"))]))
    assert len({r[1] for r in rows}) == len(rows) == len({r[2] for r in rows})
    assert len(rows) == 9  # null is no node, but numbered
    for a in rows:
        inside = [b for b in rows if b[1] > a[1] and b[2] < a[2]]
        assert all(b[3] > a[3] for b in inside)
    top = next(r for r in rows if r[4] == "a")
    assert sum(b[1] > top[1] and b[2] < top[2] for b in rows) == 6


def test_links_keep_equal_names_apart(spark):
    rec = {"map": [{"id": "f", "steps": [{"key": "s", "endpoints": ["A"]}]}, {"id": "f", "steps": [{"key": "s", "endpoints": ["B", "B", None, ""]}, {"key": "t"}]}]}
    assert linked(spark, [(1, json.dumps(rec), "clash")]) == [(1, "f", "s", ""), (1, "f", "s", "A"), (1, "f", "s", "B"), (1, "f", "s", "B")]


def test_childless_steps_stay_with_null(spark):
    rec = {"map": [{"id": "f", "steps": [{"key": "t"}, {"key": "u", "endpoints": []}]}, {"id": "g"}]}
    got = link(node_table(table(spark, [(1, json.dumps(rec), None)]), ["rec_no"], "facts", TYPES), ["rec_no"], ["flow", "step", "end"]).collect()
    assert sorted((r["step_name"], r["end_value"]) for r in got) == [("t", None), ("u", None)]


def test_nothing_comes_of_broken_records(spark):
    bad = [(1, None, ""), (2, "", ""), (3, '{"map": [', ""), (4, "[]", ""), (5, '"text"', ""), (6, "7", "")]
    assert linked(spark, bad) == []
    assert linked(spark, []) == []


def test_layouts_and_repeats(spark):
    plain = {"map": [{"id": "f", "steps": [{"key": "f/s", "endpoints": "A"}]}]}
    filed = {"map": {"f": {"steps": {"f/s": {"endpoints": [{"endpoint": "A", "line": 3}]}}}}}
    texts = [json.dumps(plain), json.dumps(filed), json.dumps(json.dumps(plain)), json.dumps({"schema": 2, "facts": plain}), json.dumps(plain, indent=1)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] * 2
    assert set(linked(spark, rows, FACTS, ("flow", "step", "endpoint"))) == {(i, "f", "f/s", "A") for i in range(5)}


def test_deep_and_long_records(spark):
    deep = "[" * 3000 + "]" * 3000
    assert label(parse(deep), {}) == []
    long = {"map": [{"id": "f", "steps": [{"key": "s", "endpoints": ["x" * 1_000_000]}]}]}
    assert len(linked(spark, [(1, json.dumps(long), "")])[0][3]) == 1_000_000


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


@given(VALUES, st.sampled_from([None, 1]))
def test_the_stack_reads_what_the_parser_reads(value, indent):
    assert nested._parsed(json.dumps(value, indent=indent)) == value


@given(st.text(alphabet='{}[]",: 1a\\', max_size=9))
def test_the_stack_refuses_what_the_parser_refuses(text):
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            nested._parsed(text)
    else:
        assert nested._parsed(text) == want


def test_records_of_any_depth(spark):
    deep = '{"map":[{"id":"f","x":' + '{"a":[' * 100_000 + "1" + "]}" * 100_000 + ',"steps":[{"key":"s","endpoints":["A"]}]}]}'
    assert linked(spark, [(1, deep, ""), (2, deep[:-1], ""), (3, json.dumps(json.dumps(json.dumps(json.dumps(deep)))), "")]) == [(1, "f", "s", "A"), (3, "f", "s", "A")]
    bad = [(1, None, ""), (2, " ", ""), (3, '{"map": [', ""), (4, "[]", ""), (5, "[" * 200_000, ""), (6, deep, "")]
    assert sorted(map(tuple, rejected(table(spark, bad), ["rec_no"], "facts").collect())) == [(1, "null"), (2, "blank"), (3, "not complete JSON"), (5, "not complete JSON")]


def test_types_that_lie_in_their_own(spark):
    types = [NodeType("dir", (*("sub", "*") * k, "files", "*")[:-2] if k else ("none",), name=("id",), holds="object") for k in range(4)]
    types += [NodeType("file", (*("sub", "*") * k, "files", "*"), holds="scalar") for k in range(1, 4)]
    assert nesting(types) == {"dir"}
    rec = {"sub": [{"id": "a", "sub": [{"id": "b", "files": ["1"], "sub": [{"id": "c", "files": ["2"]}]}, {"id": "d"}], "files": ["3", "4"]}, {"id": "e", "files": []}], "files": ["none"]}
    rows = [(1, json.dumps(rec), ""), (1, json.dumps(rec), "")]
    got = link(node_table(table(spark, rows), ["rec_no"], "facts", types), ["rec_no"], ["dir", "file"], nesting(types)).collect()
    assert sorted((r["dir_name"], r["file_value"]) for r in got if r["file_value"]) == [("a", "3"), ("a", "4"), ("b", "1"), ("c", "2")]
    assert sorted(r["dir_name"] for r in got if r["file_value"] is None) == ["d", "e"]
