"""Duplicates hidden by formatting differences (problem 3).

Method: progressive partition refinement. The first pass gives every record two cheap invariants that
no formatting difference changes: the number of its letters and digits and a hash of their histogram.
Only classes with several members go on to the costlier keys: the text's letters and digits in
order, and, where the text is a list of named fields, the sorted fields. Records are linked if either key
agrees, and a class is a connected component of these links.

Scale: both passes scan the table; what is shuffled is numbers, two a record in the first pass, and in the second
the 128-bit keys of members of several-member classes. Those are looked up where they are few enough to be broadcast; beyond that the keys are
computed in the scan and joined as numbers, with the same result, so no text is ever shuffled. Components are found over distinct keys: only
texts whose field keys differ, or fields whose texts differ, go through rounds of least labels with doubling, each round written to the
shared folder. A class that holds a third of all rows is reduced by partial aggregates and looked up through a salted join.

Cases: NULL, empty and short texts (fewer than ``min_chars`` letters and digits) form no class and are
returned by ``record_classes`` as their own; a record delivered twice counts once; ties go to the smallest id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewright.cluster import fits_broadcast, key_join, lookup_join, materialize

MIN_CHARS = 40


def _cheap(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    from quirewright.llm.hashing import BAG, packed

    weight = np.zeros(256, np.uint64)
    one = np.zeros(256, np.int32)
    for b in range(128):
        if chr(b).isalnum():
            weight[b] = BAG[ord(chr(b).lower())]
            one[b] = 1
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        data, starts = packed(texts)
        n = np.add.reduceat(one[data], starts[:-1]) if len(texts) else np.zeros(0, np.int64)
        h = np.add.reduceat(weight[data], starts[:-1]) if len(texts) else np.zeros(0, np.uint64)
        n, h = n.astype(np.int32), h.copy()
        for i in np.flatnonzero(np.logical_or.reduceat(data > 127, starts[:-1])) if len(texts) else ():
            kept = [c for c in texts[int(i)].as_py().lower() if c.isalnum()]
            n[i] = len(kept)
            t = sum(int(BAG[ord(c)]) if c < "\x80" else (ord(c) * 0x9E3779B97F4A7C15) ^ (ord(c) << 40) for c in kept)
            h[i] = np.uint64(t & 0xFFFFFFFFFFFFFFFF)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32()), pa.array(h.view(np.int64))], names=[*batch.schema.names, "n", "histogram"])


def cheap_keys(records: DataFrame) -> DataFrame:
    """(id, text) with ``n`` letters and digits and the hash ``histogram`` of their multiset."""
    return records.select("id", "text").mapInArrow(_cheap, "id long, text string, n int, histogram long")


def letters_digits(text: Column) -> Column:
    """What of a text counts: its letters and digits in order, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


_FIELD = r"(?s)^\s*([\p{L}][\p{L}\p{N} _.-]{0,40}?)\s*[:=]\s*(.*)$"


def field_key(text: Column) -> Column:
    """The fields of a list of named fields, sorted; NULL for any other text.

    A list has at least two fields, each ``name: value`` or ``name = value``, separated by ``;``, ``|``
    or line ends. A separate piece without a name continues the value before it.
    """
    parts = F.filter(F.split(text, r"[;|\n]"), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    named = F.transform(
        parts,
        lambda p: F.struct(p.rlike(_FIELD).alias("is"), letters_digits(F.regexp_extract(p, _FIELD, 1)).alias("k"), letters_digits(F.regexp_extract(p, _FIELD, 2)).alias("v"), letters_digits(p).alias("all")),
    )
    empty = F.array().cast("array<struct<k:string,v:string>>")
    folded = F.aggregate(
        named,
        empty,
        lambda acc, p: F.when(p["is"], F.concat(acc, F.array(F.struct(p["k"].alias("k"), p["v"].alias("v"))))).otherwise(
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.transform(F.slice(acc, -1, 1), lambda q: F.struct(q["k"].alias("k"), F.concat(q["v"], p["all"]).alias("v"))),
            )
        ),
    )
    is_list = (F.size(parts) >= 2) & F.element_at(parts, 1).rlike(_FIELD)
    sorted_fields = F.array_join(F.transform(F.array_sort(folded), lambda q: F.concat(q["k"], F.lit("\u0001"), q["v"])), "\u0002")
    return F.when(text.rlike(r"[:=]") & text.rlike(r"[;|\n]") & is_list & (F.size(folded) >= 2), sorted_fields)


def _wide(key: Column) -> Column:
    """128 bits of a string, as a struct that groups and joins cheaply."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.reverse(key), F.lit(7)).alias("b"))


def _costly(keyed: DataFrame) -> DataFrame:
    """(id, n, histogram, a, b, fa, fb) of records: 128-bit keys of the text and, for a list, of its fields."""
    c = keyed.select("id", "n", "histogram", _wide(letters_digits(F.col("text"))).alias("t"), field_key(F.col("text")).alias("fields"))
    f = F.when(F.col("fields").isNotNull(), _wide(F.col("fields")))
    return c.select("id", "n", "histogram", "t.a", "t.b", f["a"].alias("fa"), f["b"].alias("fb"))


def linked(pairs: DataFrame) -> DataFrame:
    """(a, b, root): for each text key, the least id over all texts that it is linked to through equal field keys.

    ``pairs`` (a, b, fa, fb, least) has one row per text key and field key, ``least`` being the least id with both. Labels go from texts to fields
    and back until none changes; each round a text takes the label of its label's text too, so that long chains take few rounds.
    """
    texts, fields = ["a", "b"], ["fa", "fb"]
    state = materialize(pairs.withColumn("root", F.col("least")), "labels")
    while True:
        by_text = state.groupBy(*texts).agg(F.min("root").alias("t_root"))
        step = state.join(by_text.hint("merge"), texts)
        by_field = step.groupBy(*fields).agg(F.min("t_root").alias("f_root"))
        step = step.join(by_field.hint("merge"), fields).withColumn("next", F.least("t_root", "f_root"))
        jump = step.groupBy(F.col("least").alias("next")).agg(F.min("next").alias("further"))
        step = step.join(jump.hint("merge"), "next", "left").select(*texts, *fields, "least", "root", F.least("next", "further").alias("new"))
        done = materialize(step, "labels")
        if not done.where("new <> root").limit(1).count():
            return done.groupBy(*texts).agg(F.min("new").alias("root"))
        state = done.select(*texts, *fields, "least", F.col("new").alias("root"))


def record_groups(records: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, first_id, copies): members of every class with several records; ``records`` has id and text."""
    keyed = cheap_keys(records).where(F.col("n") >= min_chars)
    several = materialize(
        keyed.groupBy("n", "histogram").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("n", "histogram"), "several"
    )
    if fits_broadcast(several):
        costly = _costly(keyed.join(F.broadcast(several), ["n", "histogram"]))
    else:
        costly = lookup_join(_costly(keyed), several, ["n", "histogram"], spread=["id"], materialized=True)
    costly = materialize(costly.select("id", "a", "b", "fa", "fb"), "keys")
    by_text = costly.groupBy("a", "b").agg(F.min("id").alias("least"), F.min(F.struct("fa", "fb")).alias("lo"), F.max(F.struct("fa", "fb")).alias("hi"))
    by_text = materialize(by_text, "texts")
    # texts without fields are classes by themselves; the others, one row per text and field key, are linked
    lists = costly.where("fa is not null").groupBy("a", "b", "fa", "fb").agg(F.min("id").alias("least"))
    lists = lists.join(by_text.where("hi.fa is not null").select("a", "b", F.col("least").alias("first")).hint("merge"), ["a", "b"])
    roots = linked(lists.select("a", "b", "fa", "fb", F.least("least", "first").alias("least")))
    roots = by_text.select("a", "b", "least").join(roots.hint("merge"), ["a", "b"], "left").select("a", "b", F.coalesce("root", "least").alias("first_id"))
    ids = lookup_join(costly.select("id", "a", "b"), roots, ["a", "b"], spread=["id"])
    ids = materialize(ids.select("id", "first_id").distinct(), "members")
    classes = ids.groupBy("first_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return lookup_join(ids, classes, ["first_id"], spread=["id"]).select("id", "first_id", "copies")


def page_records(page_blocks: DataFrame) -> DataFrame:
    """(id, text) of page_blocks."""
    return page_blocks.where("pb_id is not null and text is not null").select(F.col("pb_id").alias("id"), "text")


def record_copies(page_blocks: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(first_pb_id, copy_pb_id): one row for each further record of a class."""
    g = record_groups(page_records(page_blocks), min_chars)
    return g.where("id <> first_id").select(F.col("first_id").alias("first_pb_id"), F.col("id").alias("copy_pb_id"))


def record_classes(page_blocks: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per record kept: (pb_id, copies), the number of records its class had."""
    g = materialize(record_groups(page_records(page_blocks), min_chars), "groups")
    firsts = g.where("id = first_id").select(F.col("id").alias("pb_id"), "copies")
    ids = page_blocks.where("pb_id is not null").select("pb_id").distinct()
    alone = key_join(ids, g.select(F.col("id").alias("pb_id")), ["pb_id"], "left_anti")
    return firsts.unionByName(alone.select("pb_id", F.lit(1).cast("long").alias("copies")))
