"""Language id: a convolutional network over bytes (several filter widths, max pooling, softmax),
trained in numpy on labelled texts and applied to batches of fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, id_bucket

#: Production parameters: bytes of a window, embedding size, filter widths, filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 8
#: Training: most labelled documents of a language (those whose hashed id is least) and of all, characters of all (whole texts), steps, batch, rate.
SAMPLE, MOST, CHARS, STEPS, BATCH, RATE = 600, 2400, 8_000_000, 260, 64, 0.02


#: Bytes that a window must have more of to be learnt from, where any has: the tails of longer texts and very short texts tell little.
LEAST = 20


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, (n, WINDOW) bytes with zeros behind each text's end, and the number of windows per text (one at least)."""
    per = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    data = b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, per, strict=True))
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), per


class Adam:
    def __init__(self, *values: np.ndarray, rate: float):
        self.values, self.rate, self.t = values, rate, 0
        self.m, self.v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]

    def step(self, *grads: np.ndarray) -> None:
        self.t += 1
        for x, g, m, v in zip(self.values, grads, self.m, self.v, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class ByteNet:
    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = r.normal(0, 0.2, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        rare = np.argsort(y, kind="stable"), np.bincount(y, minlength=len(self.classes))
        starts, there = rare[1].cumsum() - rare[1], np.flatnonzero(rare[1])
        adam = Adam(self.embed, *self.filters, self.bias, self.out, self.out_bias, rate=RATE)
        for step in range(steps):
            adam.rate = RATE * (1 - step / steps)
            pick = r.integers(0, len(x), BATCH)
            c = r.choice(there, BATCH // 4)  # a quarter evenly over the languages, so that rare ones are seen
            pick[: len(c)] = rare[0][starts[c] + r.integers(0, rare[1][c])]
            xb, yb = x[pick].copy(), y[pick]
            for row, size in zip(xb, np.where(r.random(BATCH) < 0.5, WINDOW, r.integers(12, WINDOW, BATCH)), strict=True):
                row[size:] = 0  # short texts occur too
            emb = self.embed[xb]
            pooled, where, views = [], [], []
            for w, f in zip(WIDTHS, self.filters, strict=True):
                view = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(emb.reshape(BATCH, -1), w * EMBED, axis=1)[:, ::EMBED])
                z = view @ f
                at = z.argmax(axis=1)
                where.append(at)
                views.append(view)
                pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
            h = np.concatenate(pooled, axis=1) + self.bias
            a = np.maximum(h, 0)
            g = softmax(a @ self.out + self.out_bias)
            g[np.arange(BATCH), yb] -= 1
            g /= BATCH
            gh = (g @ self.out.T) * (h > 0)
            ge, gf = np.zeros_like(self.embed), []
            for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                part = gh[:, i * FILTERS : (i + 1) * FILTERS]
                seen = views[i][np.arange(BATCH)[:, None], where[i]]  # batch, filter, w * embed
                gf.append(np.einsum("bf,bfk->kf", part, seen).astype(np.float32))
                back = (part[:, :, None] * f.T[None]).reshape(BATCH, FILTERS, w, EMBED)
                for k in range(w):
                    np.add.at(ge, xb[np.arange(BATCH)[:, None], where[i] + k], back[:, :, k])
            adam.step(ge, *gf, gh.sum(axis=0), (a.T @ g).astype(np.float32), g.sum(axis=0))

    def tables(self) -> list[np.ndarray]:
        """A filter's value at a place is a sum of one table entry per byte; here per pair of bytes (low byte first), and per byte for the last of width 3."""
        out = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            one = [self.embed @ f[k * EMBED : (k + 1) * EMBED] for k in range(w)]
            for k in range(0, w - 1, 2):
                out.append((one[k][None, :, :] + one[k + 1][:, None, :]).reshape(65536, FILTERS))
            if w % 2:
                out.append(one[-1])
        return out

    def probabilities(self, x: np.ndarray, tables: list[np.ndarray], chunk: int = 256) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), np.float32)
        for at in range(0, len(x), chunk):
            part = x[at : at + chunk]
            pair = part[:, :-1].astype(np.int32) | part[:, 1:].astype(np.int32) << 8
            two, three, third, four, last = tables
            h = [two[pair].max(axis=1), (three[pair[:, :-1]] + third[part[:, 2:]]).max(axis=1), (four[pair[:, :-2]] + last[pair[:, 2:]]).max(axis=1)]
            out[at : at + chunk] = softmax(np.maximum(np.concatenate(h, axis=1) + self.bias, 0) @ self.out + self.out_bias)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, sample: int = SAMPLE) -> ByteNet | None:
    """The network, learnt from text and non-null lang of rows whose hashed id isn't held out, a sample of each
    language (whole texts; `sample` rows, fewer where all languages have over MOST or CHARS together; windows of over LEAST bytes); None if there are none."""
    rows = docs.where((id_bucket(5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = max(rows.select("lang").distinct().count(), 1)
    few = bounded_sample(rows, "lang", max(1, min(sample, MOST // langs)), CHARS // langs)
    got = few.toPandas().sort_values(["doc_id", "text"])
    got = got[[any(map(str.isalpha, t)) for t in got["text"]]]
    if not len(got):
        return None
    net = ByteNet(sorted(set(got["lang"])))
    x, per = windows([t.encode("utf-8", "surrogatepass") for t in got["text"]])
    y = np.repeat([net.classes.index(v) for v in got["lang"]], per)
    full = (x != 0).sum(axis=1) > LEAST
    net.train(x[full] if full.any() else x, y[full] if full.any() else y)
    return net


def _predict(net: ByteNet):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(at, 512)
                yield part_of(part, *languages(net, tables, part.column("_text").to_pylist()))

    def part_of(part, names, scores):
        kept = [i for i, n in enumerate(part.schema.names) if n != "_text"]
        return pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*[part.schema.names[i] for i in kept], "lang_pred", "score"])

    return predict


def languages(net: ByteNet, tables: list[np.ndarray], texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score per text: the mean of its windows' probabilities, by their bytes; `und` without a letter."""
    if not texts:
        return [], np.empty(0)
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    x, per = windows(data)
    size = np.maximum((x != 0).sum(axis=1), 1)[:, None].astype(np.float64)
    ends = np.concatenate([[0], per.cumsum()[:-1]])
    mean = np.add.reduceat(net.probabilities(x, tables) * size, ends) / np.add.reduceat(size, ends)
    best = mean.argmax(axis=1)
    known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts])
    return [net.classes[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)


def identify(docs: DataFrame, keep: list[str] | None = None, net: ByteNet | None = None) -> DataFrame:
    """`keep` columns (doc_id), held_out, lang_pred and score for every row of docs.

    Null texts and texts without a letter: `und`, score 0; so is everything if nothing could be
    learnt.  Equal texts get equal predictions; a null id counts as the empty text in held_out.
    Row-wise: texts are read whole, in batches, and never shuffled."""
    keep = keep or ["doc_id"]
    net = net or fit(docs)
    held = F.coalesce(id_bucket(5) == 0, F.lit(False))
    if net is None:
        return docs.select(*keep, held.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    slim = docs.select(*keep, held.alias("held_out"), F.col("text").alias("_text"))
    schema = slim.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return slim.mapInArrow(_predict(net), schema)


def keep_known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """docs without the rows whose language is `und` or less sure than `least`: a filter in the texts' own tasks.

    If nothing could be learnt, texts with a letter stay."""
    net = fit(docs)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = net.tables()
        for texts in batches:
            out = []
            for at in range(0, len(texts), 512):
                names, scores = languages(net, tables, [None if t is None else t for t in texts.iloc[at : at + 512]])
                out += [n != "und" and s >= least for n, s in zip(names, scores, strict=True)]
            yield pd.Series(out, dtype=bool)

    return docs.where(known("text"))
