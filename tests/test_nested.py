"""Nested records: against a recursive walk, and the forms a record may take."""

import json

import pytest
from pyspark.sql import functions as F

from minespark.operators import nested
from minespark.plans.trees import p4_found
from minespark.sources.nested_json import decode

DATA = "/root/testdata/sf0.001"


def links(value):
    """Brute force: recursion over the decoded record."""
    if isinstance(value, dict):
        value = value.get("tree") if isinstance(value.get("tree"), dict) else value
        value = value["forest"] if isinstance(value.get("forest"), list) else value
    trees = value if isinstance(value, list) else [value]
    out = []

    def walk(node, path):
        edges = node.get("edges")
        for i, e in enumerate([edges] if isinstance(edges, dict) else edges or []):
            e = (e or {}).get("edge", e) or {}
            child = e.get("node") or e.get("leaf")
            if e.get("node") is not None or e.get("leaf") is not None:
                out.append((path, node.get("var"), f"{path}.{i}"))
            if e.get("node"):
                walk(child, f"{path}.{i}")

    for n, t in enumerate(trees):
        if t and isinstance(t.get("node"), dict):
            walk(t["node"], str(n))
    return out


def test_against_recursion(spark):
    raw = spark.read.parquet(f"{DATA}/tree_raw.parquet").toPandas()
    raw = raw.sort_values("load_ts", kind="stable").drop_duplicates("tree_key", keep="last")
    want = []
    for k, t in zip(raw["tree_key"], raw["tree_json"]):
        s = (t or "").lstrip("\ufeff \n\t")
        try:
            v = json.JSONDecoder().raw_decode(s)[0]
            while isinstance(v, str):
                v = json.loads(v)
        except ValueError:
            continue
        if v is not None:
            want += [(k, *x) for x in links(v)]
    got = [(r.tree_key, r.parent_path, r.parent_var, r.child_path) for r in p4_found(spark, DATA).collect()]
    assert len(got) > 300
    assert sorted(got) == sorted(want)


def test_decode_forms():
    v = {"node": {"var": "a"}}
    s = json.dumps(v)
    for t in (s, "\ufeff" + s, "\n " + s + " \n", json.dumps(s), json.dumps(json.dumps(s)), "see: " + s + " end", "[note] " + s, "```json\n" + s + "\n```"):
        assert decode(t) == v, t
    for t in (None, "", "null", "see attachment", s[:-1], json.dumps(s)[:-3], "[" + s + ", {", "[" + s):
        assert decode(t) is None, t


def test_decode_very_deep():
    deep = '{"node": ' * 50_000 + '{"var": "x\\n", "n": [1, -2.5, true, null, {}]}' + "}" * 50_000
    v = decode(deep)
    for _ in range(50_000):
        v = v["node"]
    assert v == {"var": "x\n", "n": [1, -2.5, True, None, {}]}
    assert decode(deep[:-1]) is None


def test_inlining_rules():
    plan = nested.inlining_plan([("record", "a", "object"), ("a", "x", "scalar"), ("a", "b", "object"), ("b", "y", "scalar"), ("record", "c", "list"), ("c", "d", "object"), ("record", "d", "object"), ("d", "z", "scalar")])
    assert plan.tables == ["c", "d", "record"]  # repeated, shared, root; a and b are inlined
    assert plan.columns["record"] == ["a.b.y", "a.x"]
    rec = nested.inlining_plan([("record", "p", "object"), ("p", "q", "object"), ("q", "p", "object")])
    assert set(rec.tables) == {"record", "p"}


def test_tables_and_keys(spark):
    df = spark.createDataFrame([(1, '{"name": "n", "who": {"age": 3}, "items": [{"q": 1, "tags": ["u", "v"]}, {"q": 2}]}'), (2, None), (3, ""), (4, '{"items": {"q": 9}}')], "rid long, js string")
    plan, rows = nested.shred(df, "rid", "js")
    assert plan.tables == ["items", "record", "tags"]
    items = nested.flat_table(plan, rows, "rid", "items").orderBy("rid", "id").collect()
    assert [(r.rid, r.id, r.parent_table, r.parent_id, r.q) for r in items] == [(1, "0.0", "record", "0", "1"), (1, "0.1", "record", "0", "2"), (4, "0.0", "record", "0", "9")]
    tags = nested.flat_table(plan, rows, "rid", "tags").orderBy("id").collect()
    assert [(r.id, r.parent_id, r.value) for r in tags] == [("0.0.0", "0.0", "u"), ("0.0.1", "0.0", "v")]
    rec = nested.flat_table(plan, rows, "rid", "record").orderBy("rid").collect()
    assert [(r.rid, r.name, r.who_age) for r in rec] == [(1, "n", "3"), (4, None, None)]
    _, clash = nested.shred(df.withColumnRenamed("rid", "id").withColumn("fields", F.lit(1)), "id", "js")
    assert clash.columns[0] == "record_id" and clash.count() == rows.count()
    empty, none = nested.shred(df.limit(0), "rid", "js")
    assert none.count() == 0 and empty.tables == ["record"]


def test_member_names_as_data(spark):
    df = spark.range(300).select("id", F.concat(F.lit('{"k'), "id", F.lit('": {"x": 1}}')).alias("js"))
    with pytest.raises(ValueError):
        nested.schema_graph(df, "js", max_edges=100)
