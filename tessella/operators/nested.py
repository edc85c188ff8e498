"""Flattening of deeply nested semi-structured records into related tables.

The JSON text is read by Spark's own parser into one nested Arrow column per parent; the child tables are then
cut out of the Arrow buffers: list offsets give every child's parent (``list_parent_indices``), keys travel by a
vectorised ``take``, places by subtracting the parent's first offset. No row is parsed or looped over in Python.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"^\s+|\s+$"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def with_held(df: DataFrame, name: str, depth: int = 2) -> DataFrame:
    """``name`` replaced by what its JSON text holds, once text stored inside text is taken out; null for null or broken text.
    Each step is a column of its own, so that no step is evaluated more than once."""
    df = df.withColumn(name, _trimmed(F.col(name)))
    c = F.col(name)
    for _ in range(depth):
        df = df.withColumn(name, F.when(c.startswith('"'), _trimmed(F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), F.lit(0)))).otherwise(c))
    return df


def with_enveloped(df: DataFrame, name: str, envelopes: Sequence[str], only: bool = False) -> DataFrame:
    """``name`` replaced by the text of the first of ``envelopes`` that is a member of the held object, else the object
    itself (with ``only``, null)."""
    c, keys, fields = F.col(name), F.col("__keys"), F.col("__fields")
    opens = c.startswith("{")
    df = df.withColumn("__keys", F.when(opens, F.json_object_keys(c))).withColumn("__fields", F.when(opens, F.from_json(c, ", ".join(f"`{e}` string" for e in envelopes))))
    inner = F.lit(None).cast("string")
    for e in reversed(envelopes):
        inner = F.when(F.array_contains(keys, e), fields[e]).otherwise(inner)
    hit = F.arrays_overlap(keys, F.array(*map(F.lit, envelopes)))
    df = df.withColumn(name, F.when(opens & hit, inner).when(opens & F.lit(only), F.lit(None).cast("string")).otherwise(c)).drop("__keys", "__fields")
    return with_held(df, name, 1)


def elements(text: Column) -> Column:
    """The elements of a held JSON text as an array of texts: a single value is an array of one, an empty object, a
    null or text that isn't complete JSON holds nothing. Objects among the elements keep their JSON text."""
    whole = text.startswith("[") & text.endswith("]")
    return F.when(whole, F.from_json(text, "array<string>")).when(text.startswith("{") & text.endswith("}") & (F.size(F.json_object_keys(text)) > 0), F.array(text))


def nested_items(text: Column, leaves: Sequence[str]) -> Column:
    """ARRAY<STRUCT<json STRING, leaves ARRAY<STRING>>>, json null where the element is no object. The leaves are the
    elements below the first of the members ``leaves`` that isn't null, a single value as an array of one."""
    ddl = ", ".join(f"`{n}` string" for n in leaves)

    def read(e: Column) -> Column:
        obj = e.startswith("{") & e.endswith("}") & (e != "{}")
        fields = F.from_json(e, ddl)
        return F.struct(F.when(obj, e).alias("json"), F.when(obj, fields).alias("fields"))

    def texts(x: Column) -> Column:
        return F.struct(x["json"].alias("json"), F.coalesce(*(x["fields"][n] for n in leaves)).alias("text"))

    def split(x: Column) -> Column:
        text = x["text"]
        listed = F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>"))
        single = F.when((text != "") & (text != "{}"), F.array(text))
        return F.struct(x["json"].alias("json"), F.coalesce(listed, single).alias("leaves"))

    return F.transform(F.transform(F.transform(elements(text), read), texts), split)


def _positions(lists: pa.ListArray, parents: pa.Array) -> pa.Array:
    """Place of every flattened element inside its own list, from the offsets alone."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    firsts = pc.subtract(pc.cumulative_sum(lengths), lengths)
    return pc.subtract(pa.array(np.arange(len(parents))), pc.take(pc.cast(firsts, pa.int64()), parents))


def _as_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _child_batch(batch: pa.RecordBatch, keys: Sequence[str], lists: str) -> tuple[list[pa.Array], pa.Array, pa.Array, pa.Array]:
    lst = _as_array(batch.column(batch.schema.get_field_index(lists)))
    parent = pc.cast(pc.list_parent_indices(lst), pa.int64())
    return [pc.take(_as_array(batch.column(batch.schema.get_field_index(k))), parent) for k in keys], parent, _positions(lst, parent), pc.list_flatten(lst)


def explode_places(compact: DataFrame, keys: Sequence[str], lists: str) -> DataFrame:
    """(keys..., item_no INT, leaf_no INT) from ``lists`` ARRAY<ARRAY<BOOLEAN>> (leaf_marks): one row with leaf_no -1 per
    item that isn't null, and one row per true mark in it. Both numbers come from the list offsets."""
    key_fields = [f for f in compact.schema.fields if f.name in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields) + ", item_no int, leaf_no int"
    names = [f.name for f in key_fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, _, place, inner = _child_batch(batch, names, lists)
            place = pc.cast(place, pa.int32())
            is_item = pc.is_valid(inner)
            items = pc.filter(place, is_item)
            yield pa.RecordBatch.from_arrays([*(pc.filter(t, is_item) for t in taken), items, pa.array(np.full(len(items), -1, np.int32))], names=[*names, "item_no", "leaf_no"])
            owner = pc.cast(pc.list_parent_indices(inner), pa.int64())
            if len(owner):
                keep = pc.fill_null(pc.list_flatten(inner), False)
                leaf, owner = pc.filter(_positions(inner, owner), keep), pc.filter(owner, keep)
                yield pa.RecordBatch.from_arrays([*(pc.take(t, owner) for t in taken), pc.take(place, owner), pc.cast(leaf, pa.int32())], names=[*names, "item_no", "leaf_no"])

    return compact.select(*names, lists).mapInArrow(cut, ddl)


def leaf_marks(items: Column) -> Column:
    """ARRAY<ARRAY<BOOLEAN>> of nested_items: null for elements that are no objects, else for every leaf whether it holds
    something. It is all that travels where only places are asked for."""
    holds = lambda leaf: F.coalesce((leaf != "") & (leaf != "{}"), F.lit(False))
    return F.transform(items, lambda item: F.when(item["json"].isNotNull(), F.transform(F.coalesce(item["leaves"], F.array().cast("array<string>")), holds)))


def child_tables(parents: DataFrame, key: str, items: str = "items") -> tuple[DataFrame, DataFrame]:
    """Two related tables of ``parents`` (a key and a nested_items column): items (key, item_no, json) and leaves
    (key, item_no, leaf_no, leaf). Every child row carries its parent's key and place."""
    key_type = parents.schema[key].dataType.simpleString()

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (keys,), _, place, structs = _child_batch(batch, [key], items)
            json = pc.struct_field(structs, "json")
            keep = pc.is_valid(json)
            yield pa.RecordBatch.from_arrays([pc.filter(keys, keep), pc.filter(pc.cast(place, pa.int32()), keep), pc.filter(json, keep)], names=[key, "item_no", "json"])

    def leaf_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (keys,), _, place, structs = _child_batch(batch, [key], items)
            lists = pc.struct_field(structs, "leaves")
            owner = pc.cast(pc.list_parent_indices(lists), pa.int64())
            leaf = pc.list_flatten(lists)
            keep = pc.fill_null(pc.and_(pc.not_equal(leaf, ""), pc.not_equal(leaf, "{}")), False)
            columns = [pc.take(keys, owner), pc.take(pc.cast(place, pa.int32()), owner), pc.cast(_positions(lists, owner), pa.int32()), leaf]
            yield pa.RecordBatch.from_arrays([pc.filter(c, keep) for c in columns], names=[key, "item_no", "leaf_no", "leaf"])

    base = parents.select(key, items)
    return base.mapInArrow(item_rows, f"`{key}` {key_type}, item_no int, json string"), base.mapInArrow(leaf_rows, f"`{key}` {key_type}, item_no int, leaf_no int, leaf string")
