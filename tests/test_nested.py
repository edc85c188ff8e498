"""Flattening of nested JSON against a plain recursive reading."""
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import nested as N

LEAVES = ("related_files", "relatedFiles")


def places(spark, texts, envelopes=("issues",), only=False):
    df = spark.createDataFrame([(str(i), t, "clash") for i, t in enumerate(texts)], "parent_id string, text string, item_no string")
    df = N.with_enveloped(N.with_held(df, "text"), "text", list(envelopes), only)
    rows = N.explode_places(df.select("parent_id", N.leaf_marks(N.nested_items(F.col("text"), LEAVES)).alias("places")), ["parent_id"], "places").collect()
    return sorted((int(r.parent_id), r.item_no, r.leaf_no) for r in rows)


def one(spark, text, **k):
    return [(i, j) for _, i, j in places(spark, [text], **k)]


def test_shapes(spark):
    texts = [
        '[{"a":1,"related_files":["x","",null,{"path":"p"}]},"see log",0,null,{"a":2}]', '{"issues":[{"a":1}],"truncated":true}', json.dumps('[{"a":1,"relatedFiles":"one"}]'), '{"a":1,"related_files":"z"}',
        "null", "", " ", None, "{}", "[]", '[{"a":1},{"b"', '{"issues":null,"truncated":false}', '\n [\n {"a": 1,\n "related_files": null}\n]\n', json.dumps({"issues": json.dumps([{"a": 1}])}), "12", "[[{}]]",
    ]
    want = [(0, 0, -1), (0, 0, 0), (0, 0, 3), (0, 4, -1), (1, 0, -1), (2, 0, -1), (2, 0, 0), (3, 0, -1), (3, 0, 0), (12, 0, -1), (13, 0, -1)]
    assert places(spark, texts) == want


def test_only_the_member_of_a_record(spark):
    assert one(spark, '{"repo":"x","issues":[{"a":1}]}', only=True) == [(0, -1)]
    assert one(spark, '{"repo":"x"}', only=True) == []


def test_very_long_array(spark):
    items = [{"id": str(i), "related_files": ["f"] * (i % 3)} for i in range(5000)]
    assert len(one(spark, json.dumps(items))) == 5000 + sum(i % 3 for i in range(5000))


def test_child_tables_keep_links(spark):
    df = spark.createDataFrame([("p", '[{"c":"x","related_files":["a","b"]},null,{"c":"y"}]'), ("q", None)], "k string, text string")
    items, leaves = N.child_tables(df.select("k", N.nested_items(F.col("text"), LEAVES).alias("items")), "k")
    assert sorted((r.k, r.item_no, json.loads(r.json)["c"]) for r in items.collect()) == [("p", 0, "x"), ("p", 2, "y")]
    assert sorted(tuple(r) for r in leaves.collect()) == [("p", 0, 0, "a"), ("p", 0, 1, "b")]


def test_empty_table(spark):
    assert places(spark, []) == []


leaf = st.one_of(st.none(), st.just(""), st.sampled_from(["a", "b c"]), st.fixed_dictionaries({"path": st.just("p")}))
item = st.one_of(st.none(), st.integers(0, 3), st.just("see log"), st.fixed_dictionaries({"id": st.just("i")}, optional={"related_files": st.one_of(st.none(), st.lists(leaf, max_size=4))}))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(item, max_size=5), max_size=6))
def test_matches_recursive_reading(spark, docs):
    want = []
    for n, doc in enumerate(docs):
        for i, x in enumerate(doc):
            if isinstance(x, dict):
                want.append((n, i, -1))
                want += [(n, i, j) for j, f in enumerate(x.get("related_files") or []) if f not in (None, "")]
    assert places(spark, [json.dumps(d) for d in docs]) == sorted(want)
