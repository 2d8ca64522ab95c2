"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped
candidate edges, and confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, materialise

#: Production parameters: words in a shingle, bins of a signature, bins in a band, similarity in hundredths.
WORDS, BINS, ROWS, PERCENT = 5, 128, 4, 75
#: Candidates of similarity 0.75 meet in a band with probability 1 - (1 - 0.75 ** 4) ** 32 = 0.999995.
_MULT = [np.uint64(m | 1) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]  # odd multipliers, one for each place
_CACHE = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words(dict):
    """Hash of a word; keeps the first _CACHE words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHE:
            self[word] = h
        return h


def shingles(text: str | None, words: Words, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; with fewer words, of the whole sequence; no words: empty."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and white space 0x20, 0x09-0x0D
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    k = min(n, size)
    total = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        total = _mix(total + h[i : n - k + 1 + i] * _MULT[i % len(_MULT)])
    return np.unique(total)


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """(n, bins) minima.  A hash's top bits choose its bin, so a sorted set gives its minima by one
    search.  An empty bin takes the value of the first full bin on a walk that depends on the bin
    alone (optimal densification: the same walk for all sets, so similarity is kept)."""
    shift = np.uint64(64 - int(np.log2(bins)))
    sig, full = np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        b = (s >> shift).astype(np.int64)
        first = np.flatnonzero(np.diff(b, prepend=-1))
        sig[i, b[first]], full[i, b[first]] = s[first], True
    count, at, step, out = full.sum(axis=1), np.arange(bins, dtype=np.uint64), 0, sig.copy()
    one = np.flatnonzero(count == 1)  # every walk ends in the same bin
    out[one] = sig[one, full[one].argmax(axis=1)][:, None]
    left = np.flatnonzero((count > 1) & (count < bins))
    todo = ~full[left]
    while len(left):
        step += 1
        to = (_mix(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)) >> shift).astype(np.int64)
        i, j = np.nonzero(todo & full[left][:, to])
        out[left[i], j] = sig[left[i], to[j]]
        todo[i, j] = False
        more = todo.any(axis=1)
        left, todo = left[more], todo[more]
    return out


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n, bins / rows) keys: the hash of each band's minima and number."""
    n, b = sig.shape
    parts = sig.reshape(n, b // rows, rows)
    key = np.broadcast_to(np.arange(b // rows, dtype=np.uint64), (n, b // rows))
    for r in range(rows):
        key = _mix(key * _MULT[0] + parts[:, :, r])
    return key


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sets = [shingles(t.as_py(), words) for t in part.column("text")]
            keys = bands(signatures(sets)).astype(np.int64)
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            rows = [k if len(s) else [] for k, s in zip(keys, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], schema=_SIGNED)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = [shingles(t.as_py(), words).tobytes() for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(rows, pa.binary())], names=["rep", "set"])


#: Bits of a symmetric-difference sketch, in longs.
SKETCH = 16


def sketch(one: np.ndarray, other: np.ndarray) -> tuple[int, np.ndarray, int]:
    """Of two sorted sets: the size of the intersection, a bit map of the symmetric difference (one bit an element), and
    how many of its elements share a bit with another.  Two sets with the same `one` have at most
    popcount(map & map) + min(shared bits) differences in common, which bounds their own intersection from above."""
    if not len(one) or not len(other):
        only = np.concatenate([one, other])
        shared = 0
    else:
        at = np.minimum(np.searchsorted(one, other), len(one) - 1)
        same = one[at] == other
        rest = np.ones(len(one), bool)
        rest[at[same]] = False
        only, shared = np.concatenate([one[rest], other[~same]]), int(same.sum())
    flags = np.zeros(SKETCH * 64, np.uint8)
    flags[(only & np.uint64(SKETCH * 64 - 1)).astype(np.int64)] = 1
    return shared, np.packbits(flags).view(np.int64), len(only) - int(flags.sum())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact intersections.  Rows come sorted by their first side, whose set is decoded once a run."""
    last, one = None, np.empty(0, np.uint64)
    for batch in batches:
        shared, bits, extra = [], [], []
        for a, x, y in zip(batch.column("a"), batch.column("set_a"), batch.column("set_b"), strict=True):
            if a.as_py() != last:
                last, one = a.as_py(), np.frombuffer(x.as_py(), np.uint64)
            n, b, e = sketch(one, np.frombuffer(y.as_py(), np.uint64))
            shared.append(n)
            bits.append(b)
            extra.append(e)
        s, na, nb = np.array(shared, np.int64), batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        flat = pa.array(np.concatenate(bits) if bits else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * SKETCH), flat)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s), pa.array(na + nb - s), batch.column("na"), lists, pa.array(extra, pa.int32())], names=["a", "b", "shared", "joint", "na", "bits", "extra"])


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (print of the shingle set, null if empty), bands: written once, without texts."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(slim.mapInArrow(_sign, "doc_id long, n_shingles long, class binary, bands array<long>"), "signed")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it is connected with) for links (a, b), by least labels with
    pointer jumping.  Each round is written to the shared folder; the number of rounds grows with
    the logarithm of a component's diameter, and stars have diameter two."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("to"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = lower.join(jump, lower["to"] == jump["_n"], "left").select("node", "old", F.least("to", F.coalesce("_l", "to")).alias("label"))
        new = materialise(new, "labels")
        labels = new.select("node", "label")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return labels.withColumnRenamed("label", "component")


def compared(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """a, b, shared, joint, na, bits, extra: exact sizes of intersection, union and first set for each
    pair of document ids, and the sketch of their difference.

    Only documents of some pair have their sets made.  Texts move once (the ids of these documents
    grow with the input, so they are never broadcast), sets once for each pair."""
    pairs = materialise(pairs, name)
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    slim = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids.hint("merge"), "rep", "left_semi").groupBy("rep").agg(F.min("text").alias("text"))
    with batch_rows(docs.sparkSession, 1000):
        sets = materialise(slim.mapInArrow(_sets, "rep long, set binary"), name + "sets")
    sized = lambda x: sets.select(F.col("rep").alias(x), F.col("set").alias(f"set_{x}"), F.expr("octet_length(set) div 8").cast("long").alias(f"n{x}"))
    full = pairs.join(sized("b"), "b").join(sized("a"), "a")
    out = full.sortWithinPartitions("a").select("a", "b", "na", "nb", "set_a", "set_b").mapInArrow(_compare, "a long, b long, shared long, joint long, na long, bits array<long>, extra int")
    with batch_rows(docs.sparkSession, 128):  # each row holds two whole sets
        return materialise(out, name + "done")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id for every row of docs.

    1. Rows with the same shingle set form a class; only its least id goes on, so that copies cost
       nothing further.  2. Representatives that share a band bucket are joined to the bucket's
       centre: a star, one candidate a row.  Centres are the same in most buckets of a group, so a
       group of n gives about n pairs, confirmed on full sets.  3. The rest, exactly: where a
       bucket still holds several components, pairs across them that the stars did not compare are
       compared too, unless their differences from the centre exclude a link: the join itself
       bounds their intersection from above by sketches of these.  No cap anywhere.

    Null or wordless texts: empty set, linked with nothing.  Rows without an id link with nothing.
    Repeated rows: one class.  Of an id with several texts the least one is compared.  Empty input: empty output."""
    rows = signed(docs)
    reps = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    reps = materialise(reps, "reps")
    keyed = reps.where(F.col("rep").isNotNull()).select("rep", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = materialise(keyed.join(shared, "key"), "members")  # rows of shared buckets only
    # the centre of a bucket is the member with the most company over all its buckets: in a group of
    # copies of one text, that text; so one centre serves a whole group
    weight = members.groupBy("rep").agg(F.sum("c").alias("w"))
    members = materialise(members.join(weight, "rep"), "weighed")
    stars = members.groupBy("key").agg(F.max_by("rep", F.col("w") * 1.0e6 + F.pmod(F.xxhash64("rep"), F.lit(1000000))).alias("centre"))
    members = materialise(members.drop("w", "c").join(stars, "key"), "starred")
    edges = members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    first = compared(docs, edges, "stars")
    linked = F.col("shared") * 100 >= F.col("joint") * percent
    links = first.where(linked).select("a", "b")
    comps = components(links)

    # the rest: buckets with more than one component
    where = members.join(comps, members["rep"] == comps["node"], "left").select("key", "rep", "n", "centre", F.coalesce("component", "rep").alias("comp"))
    far = first.select(F.col("a").alias("centre"), F.col("b").alias("rep"), F.col("na").alias("size"), (F.col("na") - F.col("shared")).alias("gone"), "bits", "extra")
    several = where.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = materialise(where.where("rep <> centre").join(several, "key", "left_semi").join(far, ["centre", "rep"]), "open")
    x, y = open_.alias("x"), open_.alias("y")
    common = " + ".join(f"bit_count(get(x.bits, {i}) & get(y.bits, {i}))" for i in range(SKETCH))
    most = f"(x.size - x.gone - y.gone + {common} + least(x.extra, y.extra))"
    may = f"least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {percent} and {most} * {100 + percent} >= (x.n + y.n) * {percent}"
    rest = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & F.expr(may))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
    )
    more = compared(docs, rest, "rest").where(linked).select("a", "b")
    if not more.isEmpty():
        comps = components(links.union(more))

    of = reps.join(comps, reps["rep"] == comps["node"], "left").select(F.col("class").alias("_class"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("_component"))
    out = rows.join(of, F.col("class") == F.col("_class"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("_component", "doc_id")).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows that near_duplicates does not keep: one document of each group stays.
    Rows that share an id share its fate."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
