"""Source divergence audit: how far the vocabularies of a language's sources lie apart.

A sort-based stream.  Where a document lies, its terms are counted; a task's documents leave as runs
(lang, term, source: documents, count).  Runs are dealt out and sorted by one number, the hash of (lang, term), and one
scan over run lengths gives each term's document frequency and its counts by source: hashes found in too few documents
hold no kept term, and only the runs of the others are told apart by their strings.  A second scan over the
kept terms turns each run into probabilities and adds up partial pairs of sources and partial best terms.  A scan
holds one batch and the sums of one hash, never a group."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

#: Production parameters: least documents of a kept term, smoothing of a count, whole of the probabilities, ranks of terms.
MIN_DOCS, SMOOTH, WHOLE, TOP = 30, 5, 1_000_000_000, 50
#: Terms that a task counts before it sends them on, numbers that a scan holds for pairs, for terms, and for a step.
HELD, PAIRS, BEST, STEP = 300_000, 4_000_000, 200_000, 1_000_000
_RUN = "lang string, term string, source string, docs long, n long"
_RUNS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
#: ASCII letters in lower case and all bytes from 128 on are parts of terms; all else parts them.
_TERMS = bytes(b if b >= 128 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def groups_of(docs: DataFrame) -> DataFrame:
    """lang, source: the groups that occur, null as ''."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select(some("lang"), some("source")).distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to runs: for each (lang, source) of this part of the task each term's documents and count."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (df, n) in held.items():
            k = len(n)
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, k), terms, pa.repeat(source, k), pa.array(map(df.__getitem__, n), pa.int64()), pa.array(n.values(), pa.int64())], schema=_RUNS)

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            terms = text.as_py().translate(_TERMS).split()
            df, n = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(terms)
            df.update(set(terms))
            size += len(n) - before
            if size > HELD:
                yield from sent()
                held.clear()
                size = 0
    yield from sent()


def _changed(t: pa.Table, columns: list[str]) -> np.ndarray:
    """For each row but the first, whether it differs from the row before in some of the columns."""
    out = np.zeros(max(t.num_rows - 1, 0), bool)
    for c in columns:
        x = t.column(c).combine_chunks()
        out |= np.asarray(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)))
    return out


def _starts(t: pa.Table, columns: list[str]) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], _changed(t, columns)])) if t.num_rows else np.zeros(0, np.int64)


def _summed(t: pa.Table) -> pa.Table:
    """Runs with those of the same (h, lang, term, source) added up, in any order."""
    out = t.group_by(["h", "lang", "term", "source"], use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
    return out.rename_columns({"docs_sum": "docs", "n_sum": "n"}).select(t.column_names)


def _scan(min_docs: int):
    """Runs sorted by their hash h to kept terms: lang, term, df, sources, counts.  Between batches only the last hash's sums are held."""

    def kept(t: pa.Table) -> Iterator[pa.RecordBatch]:
        at = _starts(t, ["h"])
        often = np.add.reduceat(np.asarray(t.column("docs")), at) >= min_docs  # no term of a hash is in more documents
        if not often.any():
            return
        t = t.filter(pa.array(np.repeat(often, np.diff(at, append=t.num_rows))))
        t = _summed(t).sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")]).combine_chunks()
        at = _starts(t, ["lang", "term"])
        df = np.add.reduceat(np.asarray(t.column("docs")), at)
        ends, keep = np.append(at[1:], t.num_rows), df >= min_docs
        rows = np.flatnonzero(np.repeat(keep, ends - at))
        offsets = pa.array(np.concatenate([[0], np.cumsum((ends - at)[keep])]).astype(np.int32))
        first = pa.array(at[keep])
        lists = [pa.ListArray.from_arrays(offsets, t.column(c).take(pa.array(rows)).combine_chunks()) for c in ("source", "n")]
        heads = [t.column(c).take(first).combine_chunks() for c in ("lang", "term")]
        yield pa.RecordBatch.from_arrays([*heads, pa.array(df[keep]), *lists], names=["lang", "term", "df", "sources", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.table(batch)
            t = (t if tail is None else pa.concat_tables([tail, t])).combine_chunks()
            last = int(_starts(t, ["h"])[-1])
            if last:
                yield from kept(t.slice(0, last))
            tail = _summed(t.slice(last))
        if tail is not None:
            yield from kept(tail)

    return scan


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, df, sources, counts: the terms found in at least min_docs documents of their language, with their counts by
    source.  Every row of docs is a document."""
    slim = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    runs = slim.mapInArrow(_runs, _RUN)
    dealt = runs.withColumn("h", F.xxhash64("lang", "term")).repartition(shuffle_partitions(docs.sparkSession), "h").sortWithinPartitions("h")  # one number: a radix sort
    return materialise(dealt.mapInArrow(_scan(min_docs), "lang string, term string, df long, sources array<string>, counts array<long>"), "auditterms")


def shares(counts: np.ndarray, totals: np.ndarray, v: np.ndarray) -> np.ndarray:
    """1 + floor(WHOLE * (count + SMOOTH) / (total + SMOOTH * v)) by long division, so that nothing overflows."""
    rest, whole = counts + SMOOTH, totals + SMOOTH * v
    out = np.zeros_like(rest)
    for _ in range(3):  # WHOLE is 1000 ** 3
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def _best(rows: dict[str, list], top: int) -> dict[str, list]:
    """Of each (lang, source) the `top` rows with the greatest values, ties by term."""
    lang, source, term, value = (np.array(rows[c], dtype=object if c in ("lang", "term") else np.int64) for c in ("lang", "source", "term", "value"))
    order = sorted(range(len(value)), key=lambda i: (lang[i], source[i], -value[i], term[i]))
    out, held = [], Counter()
    for i in order:
        held[lang[i], source[i]] += 1
        if held[lang[i], source[i]] <= top:
            out.append(i)
    return {c: list(x[out]) for c, x in (("lang", lang), ("source", source), ("term", term), ("value", value))}


def _partials(top: int):
    """Kept terms with their language's dense counts and totals, to partial pairs (a < b: sources by number, term null) and terms (b null)."""
    names = ["lang", "a", "b", "term", "value"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()]

    def of_pairs(pairs: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, m in pairs.items():
            a, b = np.triu_indices(len(m), 1)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([lang] * len(a), a, b, [None] * len(a), m[a, b]), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, np.ndarray] = {}
        best: dict[str, list] = {"lang": [], "source": [], "term": [], "value": []}
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                mine = batch.filter(pc.equal(langs, lang))
                v, totals = mine.column("v")[0].as_py(), np.asarray(mine.column("totals")[0].values)
                step = max(1, STEP // len(totals))
                if lang not in pairs:
                    if sum(map(np.size, pairs.values())) + len(totals) ** 2 > PAIRS:
                        yield from of_pairs(pairs)
                        pairs.clear()
                    pairs[lang] = np.zeros((len(totals), len(totals)), np.int64)
                for i in range(0, mine.num_rows, step):
                    part = mine.slice(i, step)
                    counts = np.asarray(part.column("dense").flatten()).reshape(part.num_rows, -1)
                    p = shares(counts, totals[None], v)
                    for a in range(p.shape[1] - 1):
                        pairs[lang][a, a + 1 :] += np.abs(p[:, a + 1 :] - p[:, a : a + 1]).sum(0)
                    q = shares(counts.sum(1, keepdims=True), totals.sum(), v)
                    t, s = np.nonzero((counts > 0) & (p > q))
                    best["lang"] += [lang] * len(t)
                    best["source"] += s.tolist()
                    best["term"] += part.column("term").take(pa.array(t)).to_pylist()
                    best["value"] += (p - q)[t, s].tolist()
                    if len(best["value"]) > BEST:
                        best = _best(best, top)
                        if len(best["value"]) > BEST // 2:  # very many groups
                            yield terms(best)
                            best = {c: [] for c in best}
        yield from of_pairs(pairs)
        yield terms(_best(best, top))

    def terms(x: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((x["lang"], x["source"], [None] * len(x["lang"]), x["term"], x["value"]), kinds, strict=True)], names=names)

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) that occurs in docs.

    part `pair`: item is each other source of the language, value the distance of both vocabularies (sum over all kept terms
    of the difference of their smoothed probabilities).  part `term`: items are the `top` kept terms that the source uses
    most beyond its language, value the difference.  Ranks go by value, then by item.

    Null text, lang and source count as ''; every row is a document, repeated rows too; an empty table gives no rows; a
    language without kept terms has pairs of distance 0.  Sources of a language are held as one array; texts are read once,
    their groups a second time without texts."""
    kept, every = kept_terms(docs, min_docs), materialise(groups_of(docs), "auditgroups")
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    context = (
        every.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
        .join(v, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.transform("s", lambda x: x["source"]).alias("names"), F.transform("s", lambda x: x["n"]).alias("totals"))
    )
    context = materialise(context, "auditcontext")
    dense = F.expr("transform(names, s -> coalesce(try_element_at(_m, s), 0L))")
    d = kept.withColumn("_m", F.map_from_arrays("sources", "counts")).join(context, "lang").select("lang", "term", "v", "totals", dense.alias("dense"))
    partial = materialise(d.mapInArrow(_partials(top), "lang string, a int, b int, term string, value long"), "auditpartials")
    name = lambda c: F.get("names", F.col(c))
    sums = partial.where("term is null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    spine = context.select("lang", F.posexplode("names").alias("a", "_s"), "names").select("lang", "a", F.posexplode("names").alias("b", "_s")).where("a < b")
    both = spine.join(sums, ["lang", "a", "b"], "left").join(context, "lang").select("lang", F.inline(F.array(*[F.struct(name(x).alias("source"), name(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))])), F.coalesce("value", F.lit(0)).alias("value"))
    terms = partial.where("term is not null").join(context, "lang").select("lang", name("a").alias("source"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = both.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).withColumn("rank", rank)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
