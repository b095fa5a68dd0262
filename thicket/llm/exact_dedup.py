"""Exact duplicates with a heavy-hitter split.

Digest every text; find the frequent digests with Misra-Gries summaries (one per partition, then merged); count the
candidates exactly; broadcast the verified winners (at most CAPACITY rows) so that their copies are settled on the map
side; shuffle the remaining digests, none of which can hold more than 2/CAPACITY of the rows.

Two texts are equal when identical after lower-casing A-Z only; null counts as empty.  Of equal texts the row with the
largest doc_id stays (null is the smallest; of rows that also tie in doc_id exactly one stays).  Empty tables give
empty results; extra columns are carried by keep() and ignored by decide().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_chunks, staged, texts_of, tidy

#: Counters in a Misra-Gries summary: digests above 2/CAPACITY of the rows are certain to be found.
CAPACITY = 1024


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased (bytes.lower leaves all other characters alone)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _digests(batches: Iterator[pa.RecordBatch], column: str = "") -> Iterator[pa.RecordBatch]:
    """Adds _digest; the text is _text, or the field `column` of _all."""
    for batch in batches:
        names = batch.schema.names
        text = batch.column(names.index("_text")) if "_text" in names else batch.column(names.index("_all")).field(column)
        out = []
        for start, stop in byte_chunks(text):
            out += [hashlib.sha256(normalised(t)).digest() for t in texts_of(text, start, stop)]
        keep = [k for k, n in enumerate(names) if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.binary())], names=[*(names[k] for k in keep), "_digest"])


def digests(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(_id, _digest) of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(tidy(_digests), f"_id {kind}, _digest binary")


def merge_summary(counters: dict, more: dict, capacity: int) -> dict:
    """Add two Misra-Gries summaries and cut the sum back to `capacity` counters."""
    for k, v in more.items():
        counters[k] = counters.get(k, 0) + v
    if len(counters) > capacity:
        cut = sorted(counters.values(), reverse=True)[capacity]
        counters = {k: v - cut for k, v in counters.items() if v > cut}
    return counters


def misra_gries(keys: DataFrame, column: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, low): a lower bound of the count of at most `capacity` keys, among them every key that holds more than
    2/capacity of the rows.  Each partition keeps `capacity` counters; the summaries meet in a shuffle, never on the driver."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict = {}
        for batch in batches:
            part = batch.column(0).value_counts()
            more = dict(zip(part.field(0).to_pylist(), part.field(1).to_pylist(), strict=True))
            more.pop(None, None)
            counters = merge_summary(counters, more, capacity)
        if counters:
            yield pa.RecordBatch.from_arrays([pa.array(list(counters), pa.binary()), pa.array(list(counters.values()), pa.int64())], names=["key", "low"])

    parts = keys.select(column).mapInArrow(summarise, "key binary, low long")
    return parts.groupBy("key").agg(F.sum("low").alias("low")).orderBy(F.desc("low"), "key").limit(capacity)


def heavy_winners(keyed: DataFrame, order: F.Column, capacity: int = CAPACITY) -> DataFrame:
    """(_digest, _win, _size) of the Misra-Gries candidates, counted exactly over all rows."""
    candidates = misra_gries(keyed, "_digest", capacity).where("low > 1").select(F.col("key").alias("_digest"))
    exact = keyed.join(F.broadcast(candidates), "_digest", "left_semi").groupBy("_digest").agg(F.max(order).alias("_win"), F.count(F.lit(1)).alias("_size"))
    return staged(exact, "heavy", files=1)


def decide(df: DataFrame, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = staged(digests(df, text, id_col).withColumn("_row", F.monotonically_increasing_id()), "digests")
    order = F.struct("_id", "_row")
    winners = heavy_winners(keyed, order, capacity)
    group = Window.partitionBy("_digest")
    # one sized broadcast settles the heavy groups; the others go through the shuffle
    light = keyed.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti").withColumns({"_win": F.max(order).over(group), "_size": F.count(F.lit(1)).over(group)})
    heavy = keyed.join(F.broadcast(winners), "_digest")
    columns = [
        F.col("_id").alias(id_col),
        F.col("_win._id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_win._row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    ]
    return light.select(*columns).unionByName(heavy.select(*columns))


def keep(df: DataFrame, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The rows of df that stay, with df's columns.  Copies of heavy texts never leave the map side; of the others,
    each partition forwards at most one row per digest."""
    order = F.struct(F.col("_id"))
    winners = heavy_winners(staged(digests(df, text, id_col), "digests"), order, capacity)
    fields = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in fields]).alias("_all"), F.col(id_col).alias("_id"))
    schema = T.StructType([*packed.schema.fields, T.StructField("_digest", T.BinaryType())])
    keyed = packed.mapInArrow(tidy(lambda batches: _digests(batches, text)), schema)
    first = Window.partitionBy("_digest").orderBy(F.desc_nulls_last("_id"))
    marked = keyed.join(F.broadcast(winners), "_digest", "left").where(F.col("_size").isNull() | F.col("_win._id").eqNullSafe(F.col("_id")))
    stay = marked.withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
    return stay.select(*[F.col("_all").getField(c).alias(c) for c in fields])


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
h AS (SELECT doc_id, t, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM h
"""
