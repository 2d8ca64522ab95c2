"""Packing along a space-filling curve: token counts are projected to a few dimensions with hashed
signs, documents are range-sorted by the Hilbert key of the projection, and neighbours on the
curve fill sequences one after the other."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, text_or_empty
from .hilbert import hilbert_index

#: Production parameters: tokens of a sequence, id put after each document, projected dimensions and bits of each.
LENGTH, END, DIMS, BITS = 2048, 1, 4, 12
#: Consecutive documents of a given order that are packed along the curve together.
RUN = 1024
#: Most words whose ids a worker keeps for later tasks, and the longest such word; bytes of text that are encoded at once (one text at least).
_CACHE, _LONGEST, _BLOCK = 20_000, 64, 4_000_000
_RARE, _LOOSE = re.compile(r"[^\S \n]"), re.compile(r"\s | \s|\s\Z")


def loose(text: str) -> bool:
    """Whether white space stands next to a space or at the end."""
    if _RARE.search(text):
        return bool(_LOOSE.search(text))
    return "  " in text or " \n" in text or "\n " in text or text[-1:] in (" ", "\n")


def _tokenizer():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _words_encoding():
    """The same vocabulary as ranks, for runs of plain words: several times faster there; and the ranks, which are the ids."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own.

    Byte-level BPE splits a text into words first and never merges across them.  Where single
    spaces stand between words (no white space next to a space), a text falls apart at its
    spaces: a block's distinct ` word`s are encoded in one call, as one text, and their ids put
    where the words stand.  Ids of the first words seen, which most blocks share, are kept.  A text
    with any other white space, or that spells a special token, goes through the tokenizer as it is."""

    def __init__(self, tokenizer):
        self._t, self._known = tokenizer, {}
        self._words, ranks = _words_encoding()
        self._special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]  # found by the tokenizer before words are split
        self._heads = np.zeros(1 << 16, bool)  # ids that begin with a space
        self._heads[[i for word, i in ranks.items() if word[:1] == b" "]] = True

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self._t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ` word` for all words (none holds a space), and how many each has: every word begins at an id that begins with a space."""
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        ids = np.array(self._words.encode_ordinary(" " + " ".join(words)), np.uint32)
        cuts = np.flatnonzero(self._heads[ids])
        if len(cuts) != len(words):
            return _joined([self._encoded(" " + w) for w in words])
        return ids, np.diff(cuts, append=len(ids))

    def _units(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _learn, by way of the known words."""
        kept = [self._known.get(w) for w in words]
        new = [w for w, k in zip(words, kept, strict=True) if k is None]
        ids, sizes = self._learn(new)
        if len(self._known) < _CACHE:
            ends, data = (4 * sizes.cumsum()).tolist(), ids.tobytes()
            for w, at, to in zip(new[: _CACHE - len(self._known)], [0, *ends], ends, strict=False):
                if len(w) <= _LONGEST:
                    self._known[w] = data[at:to]
        if len(new) == len(words):
            return ids, sizes
        old = np.array([k is not None for k in kept])
        every = np.empty(len(words), np.int64)
        every[~old], every[old] = sizes, [len(k) // 4 for k in kept if k is not None]
        out, mine = np.empty(int(every.sum()), np.uint32), np.repeat(old, every)
        out[~mine], out[mine] = ids, np.frombuffer(b"".join(k for k in kept if k is not None), np.uint32)
        return out, every

    def ids(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, with the id `end` behind each text, and how many each text has."""
        plain = np.array([bool(t) and t[0] != " " and not loose(t) and not any(s in t for s in self._special) for t in texts], bool)
        split = pc.split_pattern(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.string()), " ")
        per = np.asarray(split.value_lengths()).astype(np.int64)
        words, first = split.flatten(), np.zeros(int(per.sum()), bool)
        first[per.cumsum() - per] = True
        later = words.filter(pa.array(~first)).dictionary_encode()
        heads = words.filter(pa.array(first)).dictionary_encode()  # no space before these
        parts = [
            self._units(later.dictionary.to_pylist()),
            _joined([np.array(self._words.encode_ordinary(w), np.uint32) for w in heads.dictionary.to_pylist()]),
            _joined([self._encoded(t) for t, p in zip(texts, plain, strict=True) if not p]),
            _joined([] if end is None else [np.array([end], np.uint32)]),
        ]
        base = np.cumsum([0, *(len(n) for _, n in parts)])
        data, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        # the units of each text: its words or the text itself, then the end
        codes = np.empty(len(first), np.int64)
        codes[~first], codes[first] = np.asarray(later.indices), np.asarray(heads.indices) + base[1]
        units = np.ones(len(texts), np.int64)
        units[plain] = per
        of = np.empty(int(units.sum()), np.int64)
        mine = np.repeat(plain, units)
        of[mine], of[~mine] = codes, base[2] + np.arange(len(texts) - int(plain.sum()))
        if end is not None:
            of = np.insert(of, units.cumsum(), base[3])
            units += 1
        n = sizes[of]
        at = (sizes.cumsum() - sizes)[of] - (n.cumsum() - n)
        counts = np.add.reduceat(n, units.cumsum() - units) if len(texts) else np.empty(0, np.int64)
        return data[np.repeat(at, n) + np.arange(int(n.sum()))], counts

    def block(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, counts = self.ids(texts)
        ends, data = (4 * counts.cumsum()).tolist(), ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All rows one behind the other, and the length of each."""
    return np.concatenate([np.empty(0, np.uint32), *rows]), np.array([len(r) for r in rows], np.int64)


def _signs(vocabulary: int = 1 << 16, dims: int = DIMS) -> np.ndarray:
    """(dims, vocabulary): hashed +1 / -1 of each id."""
    x = np.arange(vocabulary * dims, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.ascontiguousarray(((x & np.uint64(1)).astype(np.int32) * 2 - 1).reshape(vocabulary, dims).T)


def curve_keys(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Hilbert keys of the documents' projections: mean sign per token in each dimension, by steps of one part in 2 ** BITS of [-1, 1]."""
    mean = sums / np.maximum(counts, 1)[:, None]
    cells = np.clip(((mean * 4 + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_index(cells, BITS)


@functools.cache
def _worker() -> tuple[Encoder, np.ndarray]:
    """A worker's encoder and signs: tasks that follow one another in a process share them, and the words already known."""
    return Encoder(_tokenizer()), _signs()


_TOKENS = pa.schema([("doc_id", pa.int64()), ("run", pa.int64()), ("ids", pa.binary()), ("key", pa.int64())])


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with _BLOCK bytes of text, or one row."""
    ends = np.asarray(pc.binary_length(batch.column("text"))).astype(np.int64).cumsum()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, _BLOCK + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, to - at)
        at = to


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, signs = _worker()
    for batch in batches:
        for part in _blocks(batch):
            every, counts = encoder.ids(part.column("text").to_pylist(), END)
            ends = counts.cumsum()
            sums = np.stack([np.add.reduceat(column[every], ends - counts) for column in signs], axis=1)  # small whole numbers: exact
            offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
            small = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(every.astype(np.uint16))])  # the vocabulary has under 2 ** 16 ids
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("run"), small, pa.array(curve_keys(counts, sums))], schema=_TOKENS)


_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, curve_key long"


def _fill(length: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, used, held = (context.partitionId() if context else 0) << 33, 0, []

        def flush(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            kinds = [pa.binary() if i == 3 else pa.int64() for i in range(8)]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "curve_key"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            done, size = [], 0
            for doc, data, key in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("key").to_pylist(), strict=True):
                ids, at = np.frombuffer(data.as_py(), np.uint16), 0
                while at < len(ids):
                    take = min(len(ids) - at, length - used)
                    held.append((doc, at, take, ids[at : at + take].astype(np.uint32).tobytes(), len(ids), number, used, key))
                    at, used = at + take, used + take
                    if used == length:
                        done += held
                        size += length
                        number, used, held = number + 1, 0, []
                        if size >= 2_000_000:
                            yield flush(done)
                            done, size = [], 0
            if done:
                yield flush(done)
        yield flush(list(powers_of_two(held, number)))

    return fill


def powers_of_two(held: list[tuple], number: int) -> Iterator[tuple]:
    """The last, partial sequence cut into sequences of falling powers of two, which need no padding."""
    left, room, offset = sum(p[2] for p in held), 0, 0
    for doc, start, take, ids, total, _, _, key in held:
        at = 0
        while at < take:
            if not room:
                room, offset = 1 << (left.bit_length() - 1), 0
                left -= room
            n = min(room, take - at)
            yield doc, start + at, n, ids[4 * at : 4 * (at + n)], total, number, offset, key
            at, room, offset = at + n, room - n, offset + n
            number += not room


def stored_order(docs: DataFrame, run: int) -> DataFrame:
    """docs, as read from part files, with `run`: their place (files by name, rows in sequence) in runs of `run` documents."""
    rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_file").alias("_name"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), F.col("_file") == F.col("_name")).withColumn("run", F.expr(f"(_start + _at) div {run}L"))


def pack(docs: DataFrame, length: int = LENGTH, run: int | None = None) -> DataFrame:
    """The pieces of sequences of `length` tokens: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset, curve_key.

    Each document is its ids and END; null text counts as empty.  Texts are encoded once and the ids
    (16 bits each) written to the shared folder; one range exchange by (key, hash of the id) brings
    neighbours together and splits equal keys, such as thousands of copies, evenly.  With `run`, docs must
    be read from files, and their order there is kept: runs of so many documents follow one another, and
    the curve orders documents within each.  Each task then
    fills its sequences from a stream of rows, holding one batch; only its last sequence may be
    short, and that is cut at powers of two.  Repeated rows are packed each; empty input: no rows."""
    placed = stored_order(docs, run) if run else docs.select("doc_id", "text", F.lit(0).cast("long").alias("run"))
    slim = placed.select(F.col("doc_id").cast("long").alias("doc_id"), "run", text_or_empty().alias("text"))
    tokens = materialise(slim.mapInArrow(_encode, "doc_id long, run long, ids binary, key long"), "tokens").withColumn("_h", F.xxhash64("doc_id"))
    near = tokens.repartitionByRange(shuffle_partitions(docs.sparkSession), "run", "key", "_h").sortWithinPartitions("run", "key", "_h")
    return near.select("doc_id", "ids", "key").mapInArrow(_fill(length), _PIECES)
