"""Personal data: patterns, then information-theoretic sanitisation.

The patterns find protected entities (e-mail, IP, card, phone): the literal in one spelling, an e-mail's
local part and domain, and the kind.  Every term of a text that holds an entity stands together with it.
Over the whole corpus, a term discloses an entity if PMI(term; entity) >= alpha * IC(entity), i.e.
p(entity | term) >= p(entity) ** (1 - alpha).  All p are frequencies over distinct texts, so that copies
count once everywhere.  Small counts are corrected: a text is no evidence for itself, so p(entity | term) is
(joint - 1 + p(entity)) / df, and the other texts must exceed chance by Z standard deviations.  Disclosing
terms are generalised like the entity itself, wherever they stand."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ["email", "ip", "card", "phone", "term"]
#: Production parameters: alpha of the disclosure test, least standard deviations above chance.
ALPHA, Z = 0.9, 4.0
#: Bits of a filter (a power of two), sums that a task holds, words whose hash a worker keeps.
BITS, HELD, CACHE = 1 << 24, 100_000, 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A term is a run without white space and without these marks.
_MARKS = ".,;:!?\"'()\\[\\]{}<>"
_TERM = re.compile(f"[^\\x09-\\x0D\\x20{_MARKS}]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each `@` outwards so that long runs stay linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    first = re.search("[0-9]", text)
    if first:
        at = first.start()
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text, at) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text, at):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def hashed(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def entities(text: str, spans: list[tuple[int, int, int]]) -> set[int]:
    """Hashes of what a text's spans stand for: kind, literal in one spelling, an e-mail's local part and domain."""
    out = set()
    for kind, a, b in spans:
        value = text[a:b].lower()
        if kind == 0:
            local, _, domain = value.rpartition("@")
            out |= {f"local:{local}", f"domain:{domain}"}
        elif kind == 1:
            value = ".".join(p.lstrip("0") or "0" for p in value.split("."))
        else:
            value = "".join(c for c in value if c.isdigit())
        out |= {f"kind:{kind}", f"{kind}:{value}"}
    return set(map(hashed, out))


class Hashes(dict):
    """Hash of each word in lower case that may be a term (and passes `test`), else 0."""

    def __init__(self, test: Callable[[int], bool] = lambda h: True):
        self._test = test

    def __missing__(self, word: str) -> int:
        h = hashed(word.lower()) if len(word) > 2 and any(map(str.isalpha, word)) else 0
        h = h if h and self._test(h) else 0
        if len(self) < CACHE:
            self[word] = h
        return h


def placed(text: str, spans: list[tuple[int, int, int]], hashes: Hashes) -> list[tuple[int, int, int]]:
    """(hash, start, end) of a text's terms that overlap no span."""
    taken, end = sorted((a, b) for _, a, b in spans), 0
    heads, ends = [a for a, _ in taken], [end := max(end, b) for _, b in taken]

    def free(a: int, b: int) -> bool:
        i = bisect_left(heads, b) - 1
        return i < 0 or ends[i] <= a

    return [(h, m.start(), m.end()) for m in _TERM.finditer(text) if (h := hashes[m[0]]) and free(m.start(), m.end())]


_FOUND = "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, spans array<struct<k:int,s:int,e:int>>, entities array<long>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:4]],
    ("spans", pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))), ("entities", pa.list_(pa.int64())),
])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, held = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            found = base_spans(text)
            spans.append(found)
            held.append(sorted(entities(text, found)))
        counts = [[sum(k == kind for k, _, _ in row) for row in spans] for kind in range(4)]
        cells = [[{"k": k, "s": s, "e": e} for k, s, e in row] for row in spans]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *[pa.array(c, pa.int64()) for c in counts], pa.array(cells, _ARROW.field("spans").type), pa.array(held, _ARROW.field("entities").type)], schema=_ARROW)


def find(docs: DataFrame) -> DataFrame:
    """A row per document: pattern spans and hashes of the entities (written once, without the texts)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return materialise(slim.mapInArrow(_find, _FOUND), "pii")


def bit_filter(rows: DataFrame, column: str) -> np.ndarray:
    """BITS bits, set at the low bits of each hash in `column`: of one size for any input, and never false for a member."""
    low = F.col(column).bitwiseAND(BITS - 1)
    parts = rows.groupBy(F.shiftright(low, 15).alias("_at")).agg(F.bitmap_construct_agg(low.bitwiseAND((1 << 15) - 1)).alias("_bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for at, bits in parts:
        out[at * 4096 : (at + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def may_hold(bits: np.ndarray, h: int) -> bool:
    return bool(bits[(h & (BITS - 1)) >> 3] >> (h & 7) & 1)


def copied(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be of a text with copies."""
    low = h & (BITS - 1)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)


def over_texts(docs: DataFrame, bits: np.ndarray, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `work` makes of text_hash and text of each distinct non-null text; bits: filter of the hashes that several rows have.
    Only texts that may have copies are shuffled, one per task.  The others are picked out by the worker that does the work: a
    task with a filter in Python below it would hold two workers."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(b.filter(pa.array(~copied(bits, b.column("text_hash").to_numpy()))) for b in batches)

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        return pd.Series(copied(bits, h.to_numpy()))

    texts = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInArrow(alone, schema).unionByName(texts.where(may("text_hash")).dropDuplicates(["text_hash"]).mapInArrow(work, schema))


def _count(bits: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, df, joint = Hashes(), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            e, t, n = [None] * len(df) + [e for e, _ in joint], [*df, *(t for _, t in joint)], [*df.values(), *joint.values()]
            df.clear()
            joint.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (e, t, n)], names=["e", "t", "n"])

        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                spans = base_spans(text)
                terms = {h for h, _, _ in placed(text, spans, hashes)} if spans else set(map(hashes.__getitem__, set(_TERM.findall(text)))) - {0}
                df.update(terms)
                for e in entities(text, spans):
                    if may_hold(bits, e):
                        joint.update((e, t) for t in terms)
                        if len(df) + len(joint) > HELD:
                            yield flush()
            if len(df) + len(joint) > HELD:
                yield flush()
        yield flush()

    return count


def disclosing(docs: DataFrame, found: DataFrame, copies: np.ndarray, alpha: float = ALPHA) -> DataFrame | None:
    """t: hashes of the terms over the disclosure threshold (None if there is none), counted over distinct texts.

    Entities of one text alone can't pass, as it is no evidence for itself; their pairs aren't counted."""
    held = found.where(F.size("entities") > 0).select("text_hash", F.explode("entities").alias("e")).distinct()
    many = materialise(held.groupBy("e").agg(F.count(F.lit(1)).alias("n_entity")).where("n_entity > 1"), "piientity")
    bits = bit_filter(many, "e")
    if not bits.any():
        return None
    total = found.select("text_hash").distinct().count()
    sums = over_texts(docs, copies, _count(bits), "e long, t long, n long").groupBy("e", "t").agg(F.sum("n").alias("n"))
    sums = materialise(sums.where("e is null or n > 1"), "piicount")
    p = F.col("n_entity") / F.lit(float(total))
    least = F.pow(p, F.lit(1.0 - alpha))
    other = F.col("n") - 1
    joint = sums.where("e is not null").join(many.where(F.col("n_entity") < total), "e").where((other + p) / F.col("n") >= least)
    df = sums.where("e is null").select("t", F.col("n").alias("df"))
    rest = F.col("df") - 1
    over = ((other + p) / F.col("df") >= least) & (other - rest * p >= Z * F.sqrt(rest * p * (1 - p)))
    out = materialise(joint.join(df, "t").where(over).select("t").distinct(), "piiterm")
    return None if out.isEmpty() else out


def _look(bits: np.ndarray):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(lambda h: may_hold(bits, h))
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("text_hash").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if any(map(hashes.__getitem__, set(_TERM.findall(text)))):
                    rows += [(key, *x) for x in placed(text, base_spans(text), hashes)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["_hash", "t", "s", "e"])

    return look


def detect(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """A row per row of docs: doc_id, text_hash, n_email, n_ip, n_card, n_phone, spans (the base
    ones, array of (k, s, e) by kind and start) and terms (disclosing terms' spans, by start).

    Disclosing terms are looked up in all words of every distinct text: words that may be one (by a
    filter of fixed size) are joined to the terms by hash.  Null and empty texts have no spans;
    copies have the same spans; repeated and null ids are no matter.  Texts are read whole."""
    found = find(docs)
    copies = bit_filter(found.groupBy("text_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "text_hash")
    terms = disclosing(docs, found, copies, alpha)
    names = ["doc_id", "text_hash", *[f"n_{k}" for k in KINDS[:4]], "spans"]
    none = F.expr("cast(array() as array<struct<k:int,s:int,e:int>>)")
    if terms is None:
        return found.select(*names, none.alias("terms"))
    seen = over_texts(docs, copies, _look(bit_filter(terms, "t")), "_hash long, t long, s int, e int")
    hits = seen.join(terms, "t").groupBy("_hash").agg(F.sort_array(F.collect_list(F.struct(F.lit(4).alias("k"), "s", "e"))).alias("terms"))
    return found.join(hits, F.col("text_hash") == F.col("_hash"), "left").select(*names, F.coalesce("terms", none).alias("terms"))


def rendered(spans: str) -> str:
    """SQL for `kind:start:end` joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')"


def masked(text: str, terms: list[tuple[int, int]]) -> str:
    """text with every span generalised to its kind: <EMAIL>, <IP>, <CARD>, <PHONE>, <TERM>; spans that overlap are one, named by the first (the longest there)."""
    out, at = [], 0
    for a, b, k in sorted([(a, b, k) for k, a, b in base_spans(text)] + [(a, b, 4) for a, b in terms], key=lambda x: (x[0], -x[1], x[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """docs with all personal data generalised in `text` (and n_chars made to fit, where there is one).

    Pattern spans are found again in the texts' own tasks; only documents with disclosing terms
    have anything joined to them.  Null texts stay null; all other columns stay as they are."""
    places = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", x["s"], x["e"])), ",")
    found = detect(docs, alpha).where(F.size("terms") > 0).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.first(places).alias("_terms"))
    names = docs.columns
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")

    @F.pandas_udf("string")
    def mask(texts: pd.Series, terms: pd.Series) -> pd.Series:
        spans = [[tuple(map(int, x.split(":"))) for x in t.split(",")] if t else [] for t in terms]
        return pd.Series([None if t is None else masked(t, x) for t, x in zip(texts, spans, strict=True)])

    may = F.col("_terms").isNotNull() | F.col("text").rlike("[0-9@]")
    text = F.when(may, mask("text", "_terms")).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
