"""Toxicity: a convolutional text classifier over hashed word embeddings (several filter widths,
max pooling), with one threshold for each guessed language.  It is trained on every labelled row by
rounds of Spark tasks: each task takes its rows' steps in numpy, and the changes are averaged by block."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, shuffle_partitions
from .langid import Adam

#: Production parameters: rows of the embedding table, its width, filter widths (words), filters of each, letters of a stem.
ROWS, EMBED, WIDTHS, FILTERS, STEM = 1 << 15, 8, (1, 2, 3), 6, 4
#: Training: labelled rows of a task, passes (rounds), batch, rate; most words a worker keeps.
PART, PASSES, BATCH, RATE, CACHE = 4096, 4, 32, 0.02, 300_000
#: Embedding rows of a block, blocks that are summed in one group, steps of a logit in which thresholds are counted.
BLOCK, FAN, GRID = 2048, 64, 1024
LEVEL = 0.7
#: A text without words, clean by definition, is added for each so many labelled rows (EMPTY_LEAST at least), as labels may hold none.
EMPTY_SHARE, EMPTY_LEAST = 20, 8
#: Very common words, by which a text's language is guessed for its threshold.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to in is was that for it with as on be at by this are or from",
    "es": "de la que el en y los se del las un por con no una su para es al lo",
    "fr": "de la le et les des en un du une que est pour qui dans par pas au sur ne",
}
LANGS = [*sorted(COMMON), "other"]


class Words(dict):
    """A word's rows in the embedding table, for itself and its stem, with its languages in the high bits: packed in one number."""

    def __missing__(self, word: str) -> int:
        core = word.strip(".,;:!?\"'()[]{}<>-_*").lower()
        a = zlib.crc32(core.encode("utf-8", "surrogatepass")) % ROWS
        b = zlib.crc32(b"^" + core[:STEM].encode("utf-8", "surrogatepass")) % ROWS
        packed = a | b << 15 | _MARKS.get(core, 0) << 30
        if len(self) < CACHE:
            self[word] = packed
        return packed


_MARKS: dict[str, int] = {}
for _i, _lang in enumerate(LANGS[:-1]):
    for _w in COMMON[_lang].split():
        _MARKS[_w] = _MARKS.get(_w, 0) | 1 << _i


def codes(text: str | None, words: Words) -> np.ndarray:
    found = (text or "").split()
    return np.fromiter(map(words.__getitem__, found), np.int64, len(found)) if found else np.full(1, words[""], np.int64)


def guess(packed: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of the language whose common words are most frequent in each text; the last one if none occurs."""
    counts = np.stack([np.add.reduceat((packed >> (30 + i)) & 1, ends) for i in range(len(LANGS) - 1)], axis=1)
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(LANGS) - 1)


class WordNet:
    """score = sigmoid(logit): filters over sums of word and stem embeddings, greatest value of each over the text, linear."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.02, (2 * ROWS, EMBED)).astype(np.float32)
        self.filters = [r.normal(0, (1 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.thresholds = np.zeros(len(LANGS))
        self.rows = 0  # labelled rows that were learnt from

    def pooled(self, packed: np.ndarray, per: np.ndarray, where: bool = False):
        """(texts, filters) maxima, and with `where` their places; texts stand one behind the other, two zero words behind each."""
        room = per + max(WIDTHS) - 1
        starts = np.concatenate([[0], room.cumsum()[:-1]])
        emb = np.zeros((int(room.sum()), EMBED), np.float32)
        at = np.arange(len(packed)) + np.repeat((max(WIDTHS) - 1) * np.arange(len(per)), per)
        emb[at] = self.embed[packed & (ROWS - 1)] + self.embed[ROWS + ((packed >> 15) & (ROWS - 1))]
        gap = np.ones(len(emb), bool)  # a filter begins at a word
        gap[at] = False
        gap = np.flatnonzero(gap)
        # every filter row block by one product; a filter's value adds its blocks at consecutive places
        every = emb @ np.concatenate([f.reshape(-1, EMBED, FILTERS).transpose(1, 0, 2).reshape(EMBED, -1) for f in self.filters], axis=1)
        best, places, col = [], [], 0
        for w in WIDTHS:
            z = every[:, col : col + FILTERS].copy()
            for k in range(1, w):
                z[:-k] += every[k:, col + k * FILTERS : col + (k + 1) * FILTERS]
            col += w * FILTERS
            z[gap] = -1e9
            best.append(np.maximum.reduceat(z, starts))
            if where:
                places.append(np.stack([s + z[s : s + n].argmax(axis=0) for s, n in zip(starts, room, strict=True)]))
        return np.concatenate(best, axis=1), (places, emb, at)

    def logits(self, packed: np.ndarray, per: np.ndarray) -> np.ndarray:
        h, _ = self.pooled(packed, per)
        return np.maximum(h + self.bias, 0) @ self.out + self.out_bias[0]

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out, self.out_bias]

    def train(self, texts: list[np.ndarray], y: np.ndarray, passes: int = PASSES, seed: int = 3, turns: range | None = None, weight: float = 1.0) -> np.ndarray:
        """The passes of `turns` (of `passes` in all) over the texts, rows of label 1 weighted; how often each embedding row changed."""
        r = np.random.default_rng(seed)
        adam = Adam(*self.dense(), rate=RATE)
        square = np.full(2 * ROWS, 1e-6, np.float32)  # Adagrad by row: few rows change in a step
        changes = np.zeros(2 * ROWS, np.float32)
        for turn in range(passes) if turns is None else turns:
            order = r.permutation(len(texts))
            for s in range(0, len(order) - BATCH // 2, BATCH):
                pick = order[s : s + BATCH]
                packed, per = np.concatenate([texts[i] for i in pick]), np.array([len(texts[i]) for i in pick])
                h, (places, emb, at) = self.pooled(packed, per, True)
                h = h + self.bias
                a = np.maximum(h, 0)
                p = 1 / (1 + np.exp(-(a @ self.out + self.out_bias[0])))
                g = ((p - y[pick]) * np.where(y[pick] == 1, weight, 1) / len(pick)).astype(np.float32)
                gh = g[:, None] * self.out[None] * (h > 0)
                row_of = np.full(len(emb), -1)
                row_of[at] = np.arange(len(packed))
                gf, rows, grads = [], [], []
                for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    part, place = gh[:, i * FILTERS : (i + 1) * FILTERS], places[i]
                    total = np.zeros_like(f)
                    for k in range(w):
                        spot = np.minimum(place + k, len(emb) - 1)
                        total[k * EMBED : (k + 1) * EMBED] = np.einsum("bf,bfe->ef", part, emb[spot])
                        back = part[:, :, None] * f[k * EMBED : (k + 1) * EMBED].T[None]
                        ok = (row_of[spot] >= 0) & (part != 0)
                        rows.append(row_of[spot][ok])
                        grads.append(back[ok])
                    gf.append(total)
                adam.rate = RATE * (1 - turn / passes)
                adam.step(*gf, gh.sum(axis=0), (a * g[:, None]).sum(axis=0), g.sum(keepdims=True))
                index, grad = np.concatenate(rows), np.concatenate(grads)
                for ids in (packed[index] & (ROWS - 1), ROWS + ((packed[index] >> 15) & (ROWS - 1))):
                    np.add.at(square, ids, (grad * grad).sum(axis=1))
                    np.add.at(changes, ids, 1)
                    np.add.at(self.embed, ids, -0.1 * grad / np.sqrt(square[ids])[:, None])
        return changes

    def calibrate(self, texts: list[np.ndarray], y: np.ndarray, least: int = 20) -> None:
        self.set_thresholds(*self.counted(texts, y), least)

    def counted(self, texts: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, ...]:
        """(language, cell of the logit, clean texts, toxic texts) that occur."""
        z = np.concatenate([self.logits(np.concatenate(part), np.array([len(t) for t in part])) for part in (texts[i : i + 64] for i in range(0, len(texts), 64))])
        per = np.array([len(t) for t in texts])
        lang = guess(np.concatenate(texts), per.cumsum() - per)
        found, of = np.unique(np.stack([lang, np.floor(np.clip(z, -60, 60) * GRID).astype(np.int64)]), axis=1, return_inverse=True)
        of = of.ravel()
        return found[0], found[1], np.bincount(of, y == 0), np.bincount(of, y == 1)

    def set_thresholds(self, lang: np.ndarray, cell: np.ndarray, clean: np.ndarray, toxic: np.ndarray, least: int = 20) -> None:
        """For each language the threshold on the logit with the most right answers, in parts of each label and clean texts
        weighted threefold, in the middle of the best gap; languages with few rows of a label take the one over all."""

        def best(m):
            at, of = np.unique(cell[m], return_inverse=True)
            n0, n1 = np.bincount(of, clean[m]), np.bincount(of, toxic[m])
            z = (at + 0.5) / GRID
            right = 3 * np.concatenate([[0], np.cumsum(n0)]) / max(n0.sum(), 1) + (n1.sum() - np.concatenate([[0], np.cumsum(n1)])) / max(n1.sum(), 1)
            cuts = np.concatenate([[z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]])
            top = np.flatnonzero(right >= right.max() - 1e-9)
            return (cuts[top[0]] + cuts[top[-1]]) / 2

        self.thresholds[:] = best(np.ones(len(cell), bool))
        for i in range(len(LANGS)):
            m = lang == i
            if min(toxic[m].sum(), clean[m].sum()) >= least:
                self.thresholds[i] = best(m)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """0 to 1; the threshold of the text's language lies at LEVEL."""
        packed, per = np.concatenate(texts), np.array([len(t) for t in texts])
        lang = guess(packed, np.concatenate([[0], per.cumsum()[:-1]]))
        return 1 / (1 + np.exp(-np.clip(self.logits(packed, per) - self.thresholds[lang] + np.log(LEVEL / (1 - LEVEL)), -60, 60)))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), part.column("held"), pa.array([codes(t, words).tobytes() for t in part.column("text").to_pylist()], pa.binary())], names=["doc_id", "toxic", "held", "codes"])


def _own(batches: Iterator[pa.RecordBatch], keep) -> tuple[list[np.ndarray], np.ndarray]:
    """A task's distinct rows, whatever their order, in one order."""
    rows = sorted({(d, y, c) for batch in batches for d, y, h, c in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "toxic", "held", "codes")), strict=True) if keep(h)})
    return [np.frombuffer(c, np.int64) for _, _, c in rows], np.array([y for _, y, _ in rows], np.float32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = {(d, y, h, c) for batch in batches for d, y, h, c in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "toxic", "held", "codes")), strict=True)}
    found = Counter((h, y) for _, y, h, _ in rows)
    yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.bool_()), pa.array([y for _, y in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["held", "toxic", "n"])


def _round(net: WordNet, turn: int, weight: float, keep):
    """One pass of a task over its rows: the changes of the embedding by block (weighted by how often a row changed), and of the rest (by rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = _own(batches, keep)
        if not texts:
            return
        context, words, new = TaskContext.get(), Words(), WordNet()
        part = context.partitionId() if context else 0
        new.embed = net.embed.copy()
        for a, b in zip(new.dense(), net.dense(), strict=True):
            a[:] = b
        empty = max(EMPTY_LEAST // 2, len(texts) // EMPTY_SHARE)
        texts, y = texts + [codes(None, words)] * empty, np.append(y, np.zeros(empty, np.float32))
        changes = new.train(texts, y, seed=3 + 1_000_003 * turn + part, turns=range(turn, turn + 1), weight=weight)
        rows = [(-1, part, np.array([len(y)], np.float64), np.concatenate([(a - b).ravel() for a, b in zip(new.dense(), net.dense(), strict=True)]).astype(np.float64) * len(y))]
        moved = (new.embed - net.embed) * changes[:, None]
        for at in range(0, 2 * ROWS, BLOCK):
            if changes[at : at + BLOCK].any():
                rows.append((at, part, changes[at : at + BLOCK].astype(np.float64), moved[at : at + BLOCK].astype(np.float64)))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v for v in c], k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "part", "weight", "change"])

    return run


_CHANGE = "block long, part long, weight binary, change binary"


def _added(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    total = [sum(np.frombuffer(v, np.float64) for v in table.column(k).to_pylist()) for k in ("weight", "change")]
    return pa.table({"block": table.column("block")[:1], "part": pa.array([table.column("part")[0].as_py() // FAN]), "weight": [total[0].tobytes()], "change": [total[1].tobytes()]})


def _calibration(net: WordNet, keep):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = _own(batches, keep)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in net.counted(texts, y)], names=["lang", "cell", "clean", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, part: int = PART) -> WordNet | None:
    """Learnt from all labelled rows that aren't held out, whole texts; a quarter of them calibrates, all others train.  Rows that
    share id, text and label count once.  None if a label has no rows.

    Texts are dealt once by id and become word codes, in tasks of `part` rows at most on average.  In each of PASSES rounds every task starts from the
    same net and passes over its rows; the tasks' changes are summed by block in groups of FAN, and the driver gets the sums (as large
    as the net).  Thresholds come from counts of all calibrating rows by language and logit, in steps of 1 / GRID.  Texts without
    words are added as clean ones (EMPTY_SHARE); label 1 weighs so much more that it is half as heavy as label 0, where it is rarer."""
    free = id_bucket(3) != 1
    known = labels.where(free & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("_labelled"), F.col("toxic").cast("int").alias("toxic")).distinct()
    tasks = max(1, -(-known.count() // part))
    most = max(tasks, shuffle_partitions(docs.sparkSession))  # a join may deal out to either number
    held = F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0
    texts = docs.where(free & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartition(tasks, "doc_id")
    rows = texts.join(known.repartition(tasks, "_labelled"), F.col("doc_id") == F.col("_labelled")).select("doc_id", "toxic", held.alias("held"), "text")
    tokens = rows.mapInArrow(_tokens, "doc_id long, toxic int, held boolean, codes binary").persist(StorageLevel.DISK_ONLY)
    try:
        counts = tokens.mapInArrow(_counted, "held boolean, toxic int, n long").groupBy("held", "toxic").agg(F.sum("n").alias("n"))
        n = {(r["held"], r["toxic"]): r["n"] for r in counts.collect()}
        clean, toxic = (n.get((False, y), 0) + n.get((True, y), 0) for y in (0, 1))
        if not clean or not toxic:
            return None
        learning, checking = (_part_of(side, all((side, y) in n for y in (0, 1))) for side in (False, True))
        net, weight = WordNet(), max(1.0, clean / (2 * toxic))
        for turn in range(PASSES):
            changes, left = tokens.mapInArrow(_round(net, turn, weight, learning), _CHANGE), most
            while True:
                changes = changes.groupBy("block", F.expr(f"part div {FAN}")).applyInArrow(lambda _, t: _added(t), _CHANGE)
                left = -(-left // FAN)
                if left == 1:
                    break
            for r in changes.collect():
                w, change = np.frombuffer(r["weight"], np.float64), np.frombuffer(r["change"], np.float64)
                if r["block"] >= 0:
                    net.embed[r["block"] : r["block"] + BLOCK] += (change.reshape(-1, EMBED) / np.maximum(w, 1)[:, None]).astype(np.float32)
                    continue
                at = 0
                for value in net.dense():
                    value += (change[at : at + value.size] / w[0]).reshape(value.shape).astype(np.float32)
                    at += value.size
        cells = tokens.mapInArrow(_calibration(net, checking), "lang long, cell long, clean long, toxic long").groupBy("lang", "cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        got = [np.array(c) for c in zip(*sorted(map(tuple, cells.collect())), strict=True)]
    finally:
        tokens.unpersist()
    bare = net.counted([codes(None, Words())], np.zeros(1))
    got = [np.append(g, v * (max(EMPTY_LEAST, (clean + toxic) // EMPTY_SHARE) // 2 if k == 2 else 1)) for k, (g, v) in enumerate(zip(got, bare, strict=True))]
    net.set_thresholds(*got)
    net.rows = clean + toxic
    return net


def _part_of(side: bool, both: bool):
    """Which rows learn or calibrate: those of this side, or all where it lacks a label."""
    return lambda held: not both or held == side


def _score(net: WordNet):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                s = net.scores([codes(t, words) for t in part.column("text").to_pylist()]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= LEVEL).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, net: WordNet | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts are scored as a text without words; equal texts get equal scores; without
    labelled rows of both labels every score is 0.  Row-wise: texts are read whole, never shuffled."""
    net = net or fit(docs, labels)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(id_bucket(3) == 1, F.lit(False)).alias("held_out"), "text")
    if net is None:
        return slim.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    return slim.mapInArrow(_score(net), "doc_id long, held_out boolean, score double, predicted int")
