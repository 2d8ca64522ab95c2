"""Line dedup, centroid clustering and the source divergence audit, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shipcheck.llm import centroids, divergence, lines, mph

DOCS = "doc_id long, text string, lang string, source string, n_lines string, _lost string"


def rows_of(r, n=60):
    """Small documents with shared lines, nulls, empty texts, repeated rows and ids, and blanks of all kinds."""
    shared = [f"Shared LINE number {i} " + "wörd " * (6 + i) for i in range(5)]
    out = []
    for i in range(n):
        text = [r.choice(shared) if r.random() < 0.5 else f"line {r.random()} own" for _ in range(r.randint(0, 6))]
        text = [r.choice(["", " ", "\t\x0b"]) + (x.upper() if r.random() < 0.2 and x.isascii() else x) + r.choice(["", "\r", " \x0c"]) for x in text]
        out.append((r.choice([i, i, i, 7, None]), r.choice(["\n".join(text)] * 9 + [None]), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "hot", "hot", None, ""]), "x", "y"))
    return [*out, *out[:5]]


# --- line dedup


@settings(max_examples=30, deadline=None)
@given(st.sets(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1)), max_size=400))
def test_perfect_hash_is_minimal(keys):
    a, b = (np.array([k[i] for k in sorted(keys)], np.int64) for i in (0, 1))
    h = mph.build(a, b)
    assert sorted(mph.places(h, a, b)) == list(range(len(keys)))
    at = mph.places(h, a ^ 1, b)
    assert ((at >= -1) & (at < max(len(keys), 1))).all()


def test_perfect_hash_is_small_and_needs_distinct_keys():
    r = np.random.default_rng(1)
    a, b = r.integers(-(2**63), 2**63, (2, 100_000))
    h = mph.build(a, b)
    assert len(h.words) * 64 < 6 * len(a) and (np.sort(mph.places(h, a, b)) == np.arange(len(a))).all()
    with pytest.raises(ValueError):
        mph.build([1, 1], [2, 2])


def brute_lines(rows, chars, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    of = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                of[key(x)].add(i)
    last = {k: max((i for i in s if i is not None), default=None) for k, s in of.items() if len(s) >= least}
    out = []
    for i, t, *_ in rows:
        xs = (t or "").split("\n")
        kept = [x for x in xs if not (key(x) in last and (i is None or i != last[key(x)]))]
        out.append((i, t if len(kept) == len(xs) else "\n".join(kept), len(xs), len(xs) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("held", [lines.HELD_BYTES, 0])
def test_lines_equal_brute_force(spark, held, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 2)
    monkeypatch.setattr(lines, "PROBES", 7)
    rows = rows_of(random.Random(3))
    got = lines.dedup_lines(spark.createDataFrame(rows, DOCS), held_bytes=held)
    assert got.columns == ["doc_id", "text", "lang", "source", "_lost", "n_lines", "n_dropped"] and {r["_lost"] for r in got.select("_lost").collect()} == {"y"}
    want = brute_lines(rows, 40, 5)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == want and sum(k[3] for k in want) > 30
    assert lines.dedup_lines(spark.createDataFrame([], DOCS), held_bytes=held).count() == 0


def test_a_line_of_all_documents_and_a_long_text(spark):
    line = "the same line in every one of the documents here"
    rows = [(i, f"{line}\nown {i}", None, None, None, None) for i in range(400)] + [(400, "\n".join([line] * 20_000), None, None, None, None)]
    for held in (lines.HELD_BYTES, 0):
        got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS), held_bytes=held).collect()}
        assert got[400] == (0, rows[400][1]) and all(got[i] == (1, f"own {i}") for i in range(400))


# --- centroid clustering

VECTORS = "vec_id long, embedding array<float>, label int, x string"


def brute_lloyd(points, k, rounds):
    """points: (id, integers); ties to the smaller number, floors of means."""
    key = lambda p: (hashlib.sha256(f"3:{p[0]}".encode()).hexdigest() if p[0] is not None else "~", p[1])
    cs = [list(p[1]) for p in sorted(points, key=key)[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x: min((far(x, c), i) for i, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in points]
        for i in range(len(cs)):
            own = [x for (_, x), c in zip(points, of, strict=True) if c == i]
            if own:
                cs[i] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    return [(i, *near(x)[::-1]) for i, x in points], cs


def vector_rows(n, spread=0.05, dim=64):
    r = np.random.default_rng(n)
    middles = r.normal(size=(5, dim))
    rows = [(i, [float(np.float32(v)) for v in middles[i % 5] + spread * r.normal(size=dim)], 1, "x") for i in range(n)]
    rows += [rows[0]] * 3 + [(None, rows[1][1], None, None), (n + 1, [float("nan")] * dim, 1, "x"), (n + 2, [1.0] * (dim - 1), 1, "x"), (n + 3, None, 1, "x"), (n + 4, [None] + [1.0] * (dim - 1), 1, "x"), (n + 5, [float("-inf")] + [0.0] * (dim - 1), 1, "x")]
    return rows


def integers(rows):
    good = [(i, v) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    return [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in good]


@pytest.mark.parametrize("spread", [0.05, 1.5])
def test_clusters_equal_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    rows = vector_rows(230, spread)
    want, cs = brute_lloyd(integers(rows), 8, 10)
    got = centroids.cluster_report(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter(want)
    by = Counter()
    for _, c, d in want:
        by[c] += d
    assert all((r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) == (by[r["cluster"]], sum(by.values()), hashlib.sha256(",".join(map(str, cs[r["cluster"]])).encode()).hexdigest()) for r in got)


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.25] * 64, 1, "x") for i in range(5)]
    got = centroids.cluster_report(spark.createDataFrame(same, VECTORS)).collect()
    assert len(got) == 5 and {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)}
    empty = centroids.cluster_report(spark.createDataFrame([(1, [1.0], 1, "x")], VECTORS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    huge = centroids.cluster_report(spark.createDataFrame([(1, [3e38] * 64, 1, "x"), (2, [-3e38] * 64, 1, "x")], VECTORS))
    assert {r["distance"] for r in huge.collect()} == {0}


def test_bounds_prune_and_stay_true():
    """Round by round, with centroids that move at random: the same clusters as a full scan, true bounds, fewer distances."""
    r = np.random.default_rng(5)
    middles = r.integers(-1000, 1000, (20, 8))
    x = middles[r.integers(0, 20, 3000)] + r.integers(-40, 40, (3000, 8))
    cs = x[:20].copy()
    of = centroids.grouped(cs, 4)
    state, total = centroids.first_assignment(x, cs, of)[:3], 0
    for i in range(12):
        new = cs + r.integers(-60 // (i + 1), 60 // (i + 1) + 1, cs.shape)
        moved, cs = np.sqrt(centroids.distance(new, cs).astype(float)), new
        *state, scanned = centroids.next_assignment(x, cs, of, moved, *state)
        d = np.stack([centroids.distance(x, c) for c in cs], axis=1)
        assert (state[0] == d.argmin(1)).all()
        root = np.sqrt(d.astype(float))
        assert (state[1] >= root[np.arange(len(x)), state[0]] - 1e-6).all()
        assert (state[2] <= centroids._least_by_group(root, of, state[0]) + 1e-6).all()
        total += scanned
    assert total < 12 * d.size / 3


def test_rounds_compute_fewer_distances(spark):
    rows = vector_rows(600)
    c = centroids.yinyang(centroids.integer_vectors(spark.createDataFrame(rows, VECTORS)))
    assert c.scanned[0] == 8 * len(integers(rows)) and (len(c.scanned) == 1 or c.scanned[-1] < c.scanned[0] / 2)


# --- source divergence


def brute_audit(rows, least, top):
    groups, df, n = defaultdict(set), Counter(), Counter()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        df.update({(lang, t) for t in terms})
        n.update((lang, source, t) for t in terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for (k, t), c in df.items() if k == lang and c >= least]
        every = Counter({t: sum(n[lang, s, t] for s in sources) for t in kept})
        share = lambda count: (lambda total: {t: 1 + 10**9 * (count(t) + 5) // (total + 5 * len(kept)) for t in kept})(sum(map(count, kept)))  # noqa: B023, E731
        q, p = share(every.__getitem__), {s: share(lambda t, s=s: n[lang, s, t]) for s in sources}  # noqa: B023
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s)
            term = sorted((q[t] - p[s][t], t) for t in kept if n[lang, s, t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, x, -v, i) for part, found in (("pair", pair), ("term", term)) for i, (v, x) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, small, monkeypatch):
    if small:  # every buffer of the stream overflows
        for name, n in (("HELD", 5), ("PAIRS", 3), ("BEST", 4), ("STEP", 1)):
            monkeypatch.setattr(divergence, name, n)
    r = random.Random(11)
    words = ["Alpha", "ALPHA", "béta", "gamma", "δέλτα", "É", "x", "it's", "a1b", "rare" + "x" * 3000]
    rows = [(i % 50, r.choice([" ".join(r.choices(words, range(len(words), 0, -1), k=r.randint(0, 9))), None, "", "12 .."]), r.choice(["en", "en", "de", None, ""]), r.choice(["hot"] * 4 + ["a", "b", None, "", "é"]), "x", "y") for i in range(400)]
    rows += [(1, None, "none", "a", "x", "y"), (1, "alpha", "none", "b", "x", "y"), (1, "", "alone", "a", "x", "y"), *rows[:20]]
    got = Counter(map(tuple, divergence.audit(spark.createDataFrame(rows, DOCS), top=5).collect()))
    assert got == brute_audit(rows, 30, 5) and len(got) > 40
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_terms_that_share_a_hash_are_told_apart(size):
    r = random.Random(3)
    rows = [(h, lang, f"t{h}{k}", source, 1, r.randint(1, 3)) for h in range(12) for lang in ("", "en") for k in range(h % 3 + 1) for source in "abc" for _ in range(r.randint(0, 5))]
    rows.sort(key=lambda x: (x[0], r.random()))  # the order within a hash is any
    table = pa.Table.from_pylist([dict(zip(("h", "lang", "term", "source", "docs", "n"), x, strict=True)) for x in rows])
    got = [x for b in divergence._scan(8)(iter(table.to_batches(size))) for x in b.to_pylist()]
    df, n = Counter(x[1:3] for x in rows), Counter()
    for _, *key, _, count in rows:
        n[tuple(key)] += count
    want = {(lang, t): {s: n[lang, t, s] for s in "abc" if n[lang, t, s]} for (lang, t), d in df.items() if d >= 8}
    assert {(x["lang"], x["term"]): dict(zip(x["sources"], x["counts"], strict=True)) for x in got} == want and len(got) == len(want) > 5
    assert all(x["df"] == df[x["lang"], x["term"]] for x in got) and 0 < sum(d < 8 for d in df.values())


def test_runs_are_sorted_by_one_number(spark, monkeypatch):
    plans, write = [], divergence.materialise
    monkeypatch.setattr(divergence, "materialise", lambda df, name: plans.append(df) or write(df, name))
    divergence.kept_terms(spark.createDataFrame([(1, "a b", "en", "s", "x", "y")] * 40, DOCS))
    (sort,) = [x for x in plans[0]._jdf.queryExecution().executedPlan().treeString().splitlines() if "Sort [" in x]
    assert sort.count("ASC") == 1 and re.search(r"Sort \[h#\d+L ASC", sort)  # a long


@given(st.integers(0, 10**15), st.integers(0, 10**15), st.integers(1, 10**9))
def test_shares_are_exact(count, more, v):
    total = count + more
    assert divergence.shares(np.array([count]), np.array([total]), np.array([v]))[0] == 1 + 10**9 * (count + 5) // (total + 5 * v)


def test_shared_lines_are_no_part_files(spark, monkeypatch):
    written = []
    monkeypatch.setattr(lines, "materialise", lambda df, name, f=lines.materialise: (written.append(name), f(df, name))[1])
    line = "a line that is long enough to be shared by all"
    rows = [(i, f"own {i}\n{line}", "en", "s", 1, 0) for i in range(7)]
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: f"own {i}" + (f"\n{line}" if i == 6 else "") for i in range(7)}
    assert written == ["lineindex"] and spark.sparkContext._jsc.getPersistentRDDs().size() == held
