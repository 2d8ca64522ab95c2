"""Line dedup: lines that many documents share stay in one of them alone.

Lines are known by 128-bit hashes of their keys.  Those found in enough documents are dealt out to shards; each
shard is a minimal perfect hash over its line hashes that indexes three compact arrays: fingerprints (the
second half of the hash), document counts and the last document.  Documents probe the arrays, so no line is ever
joined or sorted as text."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from . import mph
from .common import batch_rows, materialise, unused

#: Production parameters: least code points of a key, least documents that share it.
MIN_CHARS, MIN_DOCS = 40, 5
#: Keys that a shard is made for, bytes of all shards up to which every task holds them, and probes that go to a shard at once otherwise.
SHARD_KEYS, HELD_BYTES, PROBES = 1 << 16, 32 << 20, 1 << 16
_BLANKS = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHARD = "shard int, n_keys long, sizes binary, words binary, ranks binary, prints binary, counts binary, last binary"


def hashed_lines(text: str = "text", min_chars: int = MIN_CHARS):
    """For each line of a text the two hashes (a, b) of its key; null where the key is too short."""
    lowered = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), "\n")
    keys = F.transform(lowered, lambda k: F.btrim(k, F.lit(_BLANKS)))
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """a, b, n_docs, last: hashes of the keys that at least min_docs documents hold, and the greatest doc_id among these.

    A document's hashes count once; a null id is one document.  Both groupings are summed up before they move, so a line
    that every document has costs a row for each task."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(F.array_compact(hashed_lines("text", min_chars)))).alias("h"))
    each = d.select("doc_id", "h.a", "h.b").distinct()
    return each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last")).where(F.col("n_docs") >= min_docs)


def build_index(shared: DataFrame, shards: int) -> DataFrame:
    """A row for each shard that has keys: its perfect hash and arrays."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        h = mph.build(a, b)
        order = np.argsort(mph.places(h, a, b))
        arrays = [*h, *(rows[c].to_numpy(dtype=np.int64)[order] for c in ("b", "n_docs", "last"))]
        return pd.DataFrame([[key[0], len(rows), *(x.tobytes() for x in arrays)]], columns=[c.split()[0] for c in _SHARD.split(", ")])

    return shared.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(one, _SHARD)


class Shard:
    """A row of the index, for probing."""

    def __init__(self, row):
        self.hash = mph.PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64), np.frombuffer(row["ranks"], np.int64))
        self.prints, self.counts, self.last = (np.frombuffer(row[c], np.int64) for c in ("prints", "counts", "last"))

    def lost(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, known: np.ndarray, min_docs: int) -> np.ndarray:
        """Which of the lines (a, b) in documents `ids` go: those of a shared key in another document than its last.  An id that isn't known is null."""
        at = mph.places(self.hash, a, b)
        some = np.flatnonzero(at >= 0)
        at, out = at[some], np.zeros(len(a), bool)
        out[some] = (self.prints[at] == b[some]) & (self.counts[at] >= min_docs) & ~(known[some] & (self.last[at] == ids[some]))
        return out


def _numbers(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null) and which are known."""
    return np.asarray(x.fill_null(0)), np.asarray(x.is_valid())


def _held(index: DataFrame, shards: int, min_docs: int):
    """A function of (doc_id, hashes by line) that says which lines go, from arrays that every task holds."""
    rows = index.collect()
    held = index.sparkSession.sparkContext.broadcast({r["shard"]: r.asDict() for r in rows})  # at most HELD_BYTES
    opened: dict[int, Shard] = {}

    @F.arrow_udf("array<boolean>")
    def lost(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        lengths = np.asarray(hashes.value_lengths())
        flat = hashes.flatten()
        keyed, flags = np.flatnonzero(np.asarray(flat.is_valid())), np.zeros(len(flat), bool)
        a, b = (np.asarray(flat.field(c).take(pa.array(keyed))) for c in ("a", "b"))
        values, known = (np.repeat(x, lengths)[keyed] for x in _numbers(ids))
        shard = a % shards
        for s in np.unique(shard).tolist():
            if s in held.value:
                if s not in opened:
                    opened[s] = Shard(held.value[s])
                mine = np.flatnonzero(shard == s)
                flags[keyed[mine]] = opened[s].lost(a[mine], b[mine], values[mine], known[mine], min_docs)
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(flags))

    return lost


def _routed(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """_id, _text (a hash), _at: places of the lines that go, where the arrays are too large for a task.

    Probes (hashes and places, no texts) go to their shard, in packets of about PROBES: a shard with many probes, such as that
    of a very common line, is copied to many packets."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"), F.posexplode(hashed_lines("text", min_chars)).alias("_p", "_h")).where("_h is not null")
    probes = materialise(d.select("_id", "_text", "_p", "_h.a", "_h.b").distinct().withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")), "lineprobes")
    packets = probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PROBES).alias("_n"))
    dealt = probes.join(packets, "shard").withColumn("_packet", F.pmod(F.xxhash64("_id", "_text", "_p"), F.col("_n")))
    packed = dealt.groupBy("shard", "_packet").agg(F.collect_list(F.struct("_id", "_text", "_p", "a", "b")).alias("_probes"))

    @F.arrow_udf("array<struct<_id:bigint,_text:bigint,_p:int>>")
    def lost(probes: pa.Array, *parts: pa.Array) -> pa.Array:
        out = []
        for i in range(len(probes)):
            shard = Shard({c: x[i].as_py() for c, x in zip(("sizes", "words", "ranks", "prints", "counts", "last"), parts, strict=True)})
            p = probes[i].values
            ids, known = _numbers(p.field("_id"))
            go = shard.lost(np.asarray(p.field("a")), np.asarray(p.field("b")), ids, known, min_docs)
            out.append(p.filter(pa.array(go)).to_pylist())
        return pa.array([[{k: r[k] for k in ("_id", "_text", "_p")} for r in rows] for rows in out], pa.list_(pa.struct([("_id", pa.int64()), ("_text", pa.int64()), ("_p", pa.int32())])))

    with batch_rows(spark, 8):
        gone = materialise(packed.join(index, "shard").select(F.inline(lost("_probes", "sizes", "words", "ranks", "prints", "counts", "last"))), "linesgone")
    return gone.groupBy("_id", "_text").agg(F.collect_list("_p").alias("_at"))


@F.arrow_udf(ArrayType(BooleanType()))
def _flags(n: pa.Array, at: pa.Array) -> pa.Array:
    """n flags, set at the places `at`."""
    lengths = np.asarray(n)
    starts, flags = np.cumsum(lengths) - lengths, np.zeros(int(lengths.sum()), bool)
    flags[np.repeat(starts, np.asarray(at.value_lengths().fill_null(0))) + np.asarray(at.flatten())] = True
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(flags))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """docs with text without the lines that a later document repeats, and n_lines (before), n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased.  Keys of at least min_chars code
    points that at least min_docs documents hold lose their lines in all documents but that with the greatest doc_id (in
    every row of it).  A text that loses nothing stays as it is, null included (one empty line); one that loses all its lines
    is empty.  Null ids are one document, which is never the last.  Columns named n_lines or n_dropped are replaced.

    Index arrays of up to held_bytes are held by every task, and texts are read twice and never move; larger
    ones stay dealt out, and the lines' hashes go to their shard."""
    shared = shared_lines(docs, min_chars, min_docs).persist(StorageLevel.DISK_ONLY)  # few rows in many tasks: no part file for each
    try:
        shards = max(1, -(-shared.count() // SHARD_KEYS))
        index = materialise(build_index(shared, shards), "lineindex")
    finally:
        shared.unpersist()
    size = index.agg(F.sum(F.expr(" + ".join(f"octet_length({c})" for c in ("sizes", "words", "ranks", "prints", "counts", "last"))))).first()[0] or 0
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    lost, one, two, at = (unused(docs, c) for c in ("_lost", "_id", "_text", "_at"))
    if size <= held_bytes:
        d = docs.withColumn(lost, _held(index, shards, min_docs)(F.col("doc_id").cast("long"), hashed_lines("text", min_chars)))
    else:
        gone = _routed(docs, index, shards, min_chars, min_docs).withColumnsRenamed({"_id": one, "_text": two, "_at": at})
        j = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (F.xxhash64("text") == F.col(two)), "left")
        d = j.withColumn(lost, _flags(F.size(lines), F.coalesce(at, F.expr("cast(array() as array<int>)")))).drop(one, two, at)
    d = d.withColumns({"n_lines": F.size(lost).cast("long"), "n_dropped": F.size(F.filter(lost, lambda x: x)).cast("long")})
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.get(lost, i)), "\n")
    return d.withColumn("text", F.when(F.col("n_dropped") > 0, kept).otherwise(F.col("text"))).select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
