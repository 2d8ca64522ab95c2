"""Sharding by Hilbert order: quantise metadata dimensions, sort by curve index, cut equal runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import global_rank, text_or_empty
from .hilbert import hilbert_index

BITS = 8


def _number(c: str):
    """A text's first six bytes as a number in the same order."""
    return F.expr(f"cast(conv(rpad(hex(substring(cast(cast({c} as string) as binary), 1, 6)), 12, '0'), 16, 10) as double)")


def curve_keys(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, size, text_crc32 and _key, the curve index of four quantised dimensions: language, source, size
    and id, each cut into cells of about as many rows by approximate quantiles, so that cells follow the values'
    order (texts by their first six bytes).  Nulls have cell 0; text null counts as empty."""
    size = F.octet_length(text_or_empty()).cast("long") + 1
    d = docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    axes = {"_lang": _number("lang"), "_source": _number("source"), "_size": F.col("size").cast("double"), "_id": F.col("doc_id").cast("double")}
    ends = d.select(*[c.alias(k) for k, c in axes.items()]).approxQuantile(list(axes), [i / (1 << BITS) for i in range(1, 1 << BITS)], 0.002)

    @F.pandas_udf(LongType())
    def curve(a: pd.Series, b: pd.Series, c: pd.Series, e: pd.Series) -> pd.Series:
        cells = [np.where(x.isna(), 0, np.searchsorted(cut, x.to_numpy(), side="right")) for x, cut in zip((a, b, c, e), ends, strict=True)]
        return pd.Series(hilbert_index(np.stack(cells, axis=1), BITS))

    return d.select("doc_id", "lang", "source", "size", "text_crc32", curve(*axes.values()).alias("_key"))


def shard_by_curve(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row of docs with its shard: the rows in curve order, cut into `shards` runs whose row
    counts differ by one at most (law `rows`).

    Only ids and metadata are shuffled.  Ties on the curve are ordered by id, so a hot cell is
    split like any other run.  Empty input: empty output; repeated rows: each has a slot of its own.
    Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: only law `key` has it), curve_key, lang, source."""
    ranked = global_rank(curve_keys(docs), ["_key", "doc_id", "text_crc32", "size"], name="shard")
    total = ranked.count()
    shard = F.expr(f"(_rank * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(_shard * {total}L + {shards - 1}L) div {shards}L")
    return (
        ranked.withColumn("_shard", shard)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"), (F.col("_rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_key").alias("curve_key"), "lang", "source")
    )


#: What a reader prunes shards by.
DIMENSIONS = ["curve_key", "lang", "source", "size", "doc_id"]


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """Per shard n_rows, n_bytes and the least and greatest value of each of DIMENSIONS (of lang and source also whether some are
    null): as many rows as shards."""
    ends = [f(c).alias(f"{name}_{c}") for c in DIMENSIONS for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"), *ends, *[F.bool_or(F.col(c).isNull()).alias(f"null_{c}") for c in ("lang", "source")])


def shards_to_read(ranges: DataFrame, **wanted: tuple) -> list[int]:
    """The shards that may hold rows with every wanted column between its two given values (of at most as many rows as shards)."""
    for c, (low, high) in wanted.items():
        ranges = ranges.where((F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high))
    return sorted(r[0] for r in ranges.select("shard").collect())
