"""Operators that need whole tables, against brute force: sharding, near-duplicates, mixing, packing, pipeline."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shipcheck.llm import hilbert, mixing, neardup, packing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        order = hilbert.hilbert_index(cells, bits)
        assert sorted(order) == list(range(len(cells)))
        path = cells[np.argsort(order)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    rows = [(i % 90, None if i % 13 == 0 else "t" * (i % 50), None if i % 7 == 0 else "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(203)] + [(None, "x", None, None, None)] * 2
    got = sharding.shard_by_curve(spark.createDataFrame(rows, DOCS)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert len(got) == len(rows) and set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    keys = [r["curve_key"] for s in range(16) for r in sorted(by[s], key=lambda r: r["slot"])]
    assert keys == sorted(keys)  # runs of the curve
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sharding.shard_by_curve(spark.createDataFrame([], DOCS)).count() == 0


def test_shards_are_pruned_by_their_ends(spark):
    rows = [(i, "t" * (1 + i % 300), ["en", "de", "fr", None][i % 4], f"s{i % 6}", 1) for i in range(2000)]
    sharded = sharding.shard_by_curve(spark.createDataFrame(rows, DOCS))
    ranges = sharding.shard_ranges(sharded)
    by = {r["shard"]: r for r in ranges.collect()}
    assert sum(r["n_rows"] for r in by.values()) == 2000 and any(r["null_lang"] for r in by.values())
    everything = sharded.collect()
    for wanted in ({"lang": ("de", "de")}, {"source": ("s3", "s3")}, {"doc_id": (0, 99)}, {"size": (250, 301), "lang": ("en", "fr")}):
        read = sharding.shards_to_read(ranges, **wanted)
        hit = {r["shard"] for r in everything if all(r[c] is not None and a <= r[c] <= b for c, (a, b) in wanted.items())}
        assert hit <= set(read)
        if "size" not in wanted:
            assert len(read) < 16, wanted


def brute_sets(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def brute_components(rows):
    sets = {i: brute_sets(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(r, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        yield " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", "  ", "one", "One", "two words", "a b c d", "A B\tC  d", "a b c d e"]
    for n, size, edits in ((40, 120, 4), (25, 60, 6), (10, 15, 1), (12, 300, 12), (8, 8, 1)):
        base = [r.choice(words) for _ in range(size)]
        texts += family(r, base, n, edits)
    passage = " ".join(r.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randint(5, 60))) for _ in range(40)]  # share a passage only
    chain = [f"c{i}" for i in range(130)]
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 30, 5)]  # each like the next, ends unlike
    r.shuffle(texts)
    rows = [(3 * i + 1, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_components(rows)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    kept = neardup.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.count() == len({x["component_id"] for x in got}) and kept.columns == [c.split()[0] for c in DOCS.split(", ")]


def test_near_duplicates_odd_rows(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f", "en", "s", 0)] * 3 + [(None, "a b c d e f", "en", "s", 0), (0, "A b C d e f", None, None, None), (None, None, None, None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 6 and [x["component_id"] for x in got if x["n_shingles"]] == [0] * 5


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=30), st.sets(st.integers(0, 2**64 - 1), max_size=30), st.integers(0, 20))
def test_sketch_bounds_the_intersection(base, x, y, drop):
    a, b = set(sorted(base)[drop:]) | x, set(sorted(base)[: len(base) - drop // 2]) | y
    arr = lambda s: np.array(sorted(s), np.uint64)
    (n1, m1, e1), (n2, m2, e2) = neardup.sketch(arr(base), arr(a)), neardup.sketch(arr(base), arr(b))
    assert n1 == len(base & a) and n2 == len(base & b)
    common = int(np.unpackbits((m1 & m2).view(np.uint8)).sum()) + min(e1, e2)
    assert len(base) - (len(base) - n1) - (len(base) - n2) + common >= len(a & b)


def test_densified_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 3000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.8)], r.integers(0, 2**63, max(1, n // 10), dtype=np.uint64)]))
        sig = neardup.signatures([a, b, np.empty(0, np.uint64)])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - j) < (0.25 if n > 5 else 0.6) and not sig[2].any()


def brute_edf(units):
    """Slots of one cycle by simulation with exact fractions."""
    total, done, out = sum(units.values()), dict.fromkeys(units, 0), []
    for t in range(total):
        ready = [(-(-(done[s] + 1) * total // a), s) for s, a in sorted(units.items()) if done[s] < a and done[s] * total // a <= t]
        s = min(ready)[1]
        out.append(s)
        done[s] += 1
    return out


def test_mix(spark):
    sizes = {"hot": 400, "b": 90, "c": 35, None: 20, "": 3}
    rows = [(1000 * k + i, "t", "en", s, 1) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block=4, cycle=40).collect()
    assert Counter((x["doc_id"], x["source"]) for x in got) == Counter((i, s) for i, _, _, s, _ in rows)
    blocks = {(x["source"], x["block"]): x for x in got}
    slots = sorted(x["slot"] for x in blocks.values())
    assert slots == list(range(len(blocks))) and all(x["slot"] < x["deadline"] for x in blocks.values())
    order = [s for _, s in sorted((x["slot"], str(k[0])) for k, x in blocks.items())]
    weight = {s: n**0.5 for s, n in sizes.items()}
    units = {str(s): max(1, round(w * 40 / sum(weight.values()))) for s, w in weight.items()}
    total = sum(units.values())
    seen = Counter()
    live = min(-(-n // 4) // units[str(s)] for s, n in sizes.items()) * total  # while every source has blocks
    for t, s in enumerate(order[:live]):
        assert all(abs(seen[k] - Fraction(t * a, total)) < 1 for k, a in units.items())
        seen[s] += 1
    for key in {(x["source"], x["block"]) for x in got}:
        assert sorted(x["offset"] for x in got if (x["source"], x["block"]) == key) == list(range(sum((x["source"], x["block"]) == key for x in got)))
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    again = mixing.in_order(spark.createDataFrame(rows, DOCS), block=4, cycle=40)
    assert again.columns == ["doc_id", "text", "lang", "source", "n_chars"] and again.count() == len(rows)


def test_mix_follows_given_targets(spark):
    rows = [(i, "t", "en", "ab"[i % 2], 1) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), targets={"a": 3.0, "b": 1.0}, block=1, cycle=8).collect()
    order = [x["source"] for x in sorted(got, key=lambda x: x["slot"])]
    want = brute_edf({"a": 6, "b": 2})
    assert order[:200] == want * 25


def test_mix_keeps_to_the_exact_targets(spark):
    def deviation(sizes, targets, block=1):
        rows = [(1_000_000 * k + i, "t", "en", s, 1) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
        got = mixing.mix(spark.createDataFrame(rows, DOCS), targets=targets, block=block).select("source", "block", "slot", "deadline").distinct().collect()
        assert sorted(x["slot"] for x in got) == list(range(len(got))) and all(x["slot"] < x["deadline"] for x in got)
        weight = targets or {s: n**0.5 for s, n in sizes.items()}
        total, seen, worst = sum(weight.values()), Counter(), 0
        for t, x in enumerate(sorted(got, key=lambda x: x["slot"])):
            worst = max(worst, *(abs(seen[s] - t * w / total) for s, w in weight.items()))
            seen[x["source"]] += 1
            if seen[x["source"]] == sizes[x["source"]]:
                break  # from here on others take its share
        assert len(got) == sum(sizes.values())
        return worst, t

    worst, t = deviation({"hot": 9000, **{f"s{i}": 500 for i in range(19)}}, None)
    assert worst < 1 and t > 5000
    worst, t = deviation({"hot": 900, **{f"s{i}": 3 for i in range(999)}}, {"hot": 0.5, **{f"s{i}": 0.5 / 999 for i in range(999)}})
    assert worst < 1 and t > 1000


def brute_pfair(blocks, weight):
    """Source and block of every slot: one simulation over all slots with exact fractions, through the ends of sources."""
    ends = sorted({Fraction(n, weight[s]) for s, n in blocks.items()})
    fluid = lambda v: sum(min(Fraction(n), weight[s] * v) for s, n in blocks.items())
    by_end = sorted(blocks, key=lambda s: (Fraction(blocks[s], weight[s]), s))
    done, out = dict.fromkeys(blocks, 0), []
    for t in range(sum(blocks.values())):
        ready = []
        for i, s in enumerate(by_end):
            if done[s] < blocks[s] and fluid(Fraction(done[s], weight[s])) // 1 <= t:
                ready.append((-(-fluid(Fraction(done[s] + 1, weight[s])) // 1), i, s))
        due, _, s = min(ready)
        assert t < due
        out.append((s, done[s]))
        done[s] += 1
    assert len(ends) > 1
    return out


def test_frames_are_parts_of_one_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CYCLE", 8)
    r = random.Random(7)
    for case in range(3):
        blocks = {f"s{i}": r.randint(1, 90) for i in range(3 + 2 * case)}
        weight = {s: r.choice([1, 2, 3, 5, 11]) for s in blocks}
        sizes = spark.createDataFrame([(s, n) for s, n in blocks.items()], "_src string, n_docs long")
        flow = mixing.fluid(mixing.source_weights(sizes, {s: float(w) for s, w in weight.items()}, 0.5, sum(weight.values())), 1, sum(weight.values()))
        assert flow.select("_h").first()[0] < sum(blocks.values()) / 2  # several frames
        got = sorted(mixing.block_slots(mixing.released(flow, 4)).collect(), key=lambda x: x["slot"])
        assert [(x["_psrc"], x["_pb"]) for x in got] == brute_pfair(blocks, weight)


def test_mix_of_5000_sources(spark):
    sizes = {"hot": 9000, **{f"s{i}": 1 + i % 3 for i in range(5000)}}
    table = spark.createDataFrame(list(sizes.items()), "_src string, n_docs long")
    got = mixing.block_slots(mixing.released(mixing.fluid(mixing.source_weights(table, None, 0.5, None), 1, None), 4)).collect()
    order = [x["_psrc"] for x in sorted(got, key=lambda x: x["slot"])]
    assert Counter(order) == Counter(sizes) and sorted(x["slot"] for x in got) == list(range(len(got)))
    assert all(x["release"] <= x["slot"] < x["deadline"] for x in got)
    total, seen, first_end = sum(n**0.5 for n in sizes.values()), Counter(), 5000  # sources of one block end from there on
    for t, s in enumerate(order[:first_end]):
        if t % 50 == 0:
            assert max(abs(seen[k] - t * n**0.5 / total) for k, n in sizes.items()) < 1
        seen[s] += 1


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) + r.choice(["", "", ",", ".", "9"])
    texts = [None, "", " ", "a  b", "\n x", "<|endoftext|> y", "plain words <|endoftext|>", "a<|endoftext|>b c d", "日本 語\u3000x", "tail "] + [" ".join(word() for _ in range(r.choice([3, 50, 900, 4000]))) for _ in range(60)] + ["same text here"] * 20
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    pieces = packing.pack(spark.createDataFrame(rows, DOCS)).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for i, t, *_ in rows:
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(own[i], key=lambda p: p["start"])
        assert [x for p in parts for x in np.frombuffer(p["ids"], np.uint32)] == want
        assert [p["start"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))] and {p["doc_tokens"] for p in parts} == {len(want)}
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == [sum(q["length"] for q in s[:k]) for k in range(len(s))]
        total = sum(p["length"] for p in s)
        assert total <= 2048 and total & (total - 1) == 0  # full, or a power of two: never padded
    twice = packing.pack(spark.createDataFrame([rows[10]] * 2, DOCS)).collect()
    assert sum(p["length"] for p in twice) == 2 * twice[0]["doc_tokens"]
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from shipcheck.llm.common import materialise

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "personal_data", "mixed", "packed"]
    counts = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        before, d = d, materialise(f(spark, d, "/root/testdata/sf0.001"), "test")
        assert d.columns == before.columns
        counts.append(d.count())
    assert counts[0] >= 195 and counts[1] < counts[0] and counts[1] == counts[2] == counts[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, d, "/root/testdata/sf0.001")
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in d.select("doc_id").collect()}


def test_sequences_follow_the_mix(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ne", "ru", "ta"]) for _ in range(4))
    rows = [(i, f"the of {' '.join(word() for _ in range(60))}", "en", "hot" if i < 900 else f"s{i % 3}", 1) for i in range(1500)]
    source = {i: s for i, _, _, s, _ in rows}
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(packing, "RUN", 200)
    stages = [s for s in corpus_pipeline.STAGES if s[0] in ("mixed", "packed")]

    def order(stages):
        monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
        pieces = corpus_pipeline.run(spark, str(tmp_path)).where("start = 0").orderBy("sequence_id", "offset").collect()
        return [p["doc_id"] for p in pieces]

    mixed, plain = order(stages), order(stages[1:])
    assert sorted(mixed) == sorted(plain) == list(range(1500)) and mixed != plain
    weight = 900**0.5 / (900**0.5 + 3 * 200**0.5)
    for at in range(0, 1000, 200):  # while every source has blocks
        assert abs(sum(source[i] == "hot" for i in mixed[at : at + 200]) - 200 * weight) < 3 * mixing.BLOCK


def test_stages_keep_columns_of_any_name(spark):
    from shipcheck.llm import langid, pii

    extra = ["component_id", "kept", "rep", "key", "class", "score", "lang_pred", "slot", "offset", "spans", "terms", "n", "c", "w", "a", "b", "label", "node"]
    rows = [(i, f"text number {i} mail{i}@x.org the quick", "en", "s", 1, *extra) for i in range(30)] + [(5, None, None, None, None, *extra)]
    d = spark.createDataFrame(rows, DOCS + "".join(f", {c} string" for c in extra))
    for stage, n in ((langid.keep_known, 30), (neardup.keep_one, 31), (pii.sanitise, 31), (mixing.in_order, 31)):
        got = stage(d)
        assert got.columns == d.columns and got.count() == n
        assert {tuple(r[c] for c in extra) for r in got.select(*extra).collect()} == {tuple(extra)}
    empty = d.where("false")
    for stage in (langid.keep_known, neardup.keep_one, pii.sanitise, mixing.in_order):
        assert stage(empty).count() == 0


def test_an_id_with_several_texts(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base), "en", "s", 0), (1, "zzz other words entirely", "en", "s", 0), (2, " ".join([*base[:-1], "x"]), "en", "s", 0), (3, None, None, None, None)]
    seen = {tuple(sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(n)).collect())) for n in (1, 3, 7)}
    assert len(seen) == 1


def test_mix_of_many_sources(spark):
    rows = [(i, "t", "en", f"s{i % 1500}" if i % 3 else "hot", 1) for i in range(9000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block=4).collect()
    assert len(got) == 9000 and len({(x["source"], x["block"]) for x in got}) == len({x["slot"] for x in got})


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    import pytest
    from types import SimpleNamespace as O

    from shipcheck.llm import common

    none = O(isDefined=lambda: False)
    session = O(conf=O(get=lambda k, d: d), sparkContext=O(master="spark://x:7077", _jsc=O(sc=lambda: O(getCheckpointDir=lambda: none))))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


def test_tasks_of_a_worker_share_known_words():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array(["the ship sails to zgorfen, now", " a  b "])], names=["doc_id", "run", "text"])
    first = next(packing._encode(iter([batch])))
    encoder = packing._worker()[0]
    assert "zgorfen," in encoder._known and next(packing._encode(iter([batch]))).equals(first) and packing._worker()[0] is encoder
    fresh = packing.Encoder(packing._tokenizer()).block(batch.column("text").to_pylist())
    assert [np.frombuffer(a.as_py(), np.uint16)[:-1].tolist() for a in first.column("ids")] == [np.frombuffer(b, np.uint32).tolist() for b in fresh]


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE", 100)
    monkeypatch.setattr(packing, "_BLOCK", 700, raising=False)
    tokenizer = packing._tokenizer()
    encoder = packing.Encoder(tokenizer)
    texts = [" ".join(f"w{i}é{k}," for i in range(50)) for k in range(40)] + ["", "\nx y z", "a  b", "one", "　x y éa", "<|endoftext|> y"] + ["w1é1, w2é1, new."] * 2
    want = [t.ids for t in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(b, np.uint32).tolist() for b in encoder.block(texts)] == want
    assert len(encoder._known) == 100
    monkeypatch.setattr(packing, "_worker", lambda: (encoder, packing._signs()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["doc_id", "run", "text"])
    out = list(packing._encode(iter([batch, batch.slice(0, 0)])))
    assert [np.frombuffer(x.as_py(), np.uint16).tolist() for b in out for x in b.column("ids")] == [[*w, packing.END] for w in want] and len(out) > 30


def test_long_texts_are_encoded_in_blocks_of_bytes(monkeypatch):
    monkeypatch.setattr(packing, "_BLOCK", 20_000, raising=False)
    texts = ["long text " * n for n in (900, 900, 900, 5000, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([0] * 6), pa.array(texts)], names=["doc_id", "run", "text"])
    assert [b.column("doc_id").to_pylist() for b in packing._encode(iter([batch]))] == [[0, 1], [2], [3], [4, 5]]
