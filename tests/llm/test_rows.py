"""Operators that work row by row, against brute force: media, urls, personal data, language, toxicity, quality."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shipcheck.llm import langid, media, pii, quality, toxicity, urls, webp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


# --- media


@pytest.mark.parametrize("transforms", [[], [0], [1], [2], [3], [0, 1], [2, 0, 1], [3, 0], [1, 2]])
@pytest.mark.parametrize("references", [False, True])
def test_webp_features_round_trip(transforms, references):
    r = random.Random(str((transforms, references)))
    for cache in (0, 3, 8):
        for mode in range(14) if 0 in transforms else [11]:
            w, h = r.randint(1, 21), r.randint(1, 13)
            colours = [r.getrandbits(32) for _ in range(r.choice([1, 2, 3, 9, 40]))]
            px = [r.choice(colours) for _ in range(w * h)]
            width, height, got = webp.decode(webp.encode(px, w, transforms, cache, references, mode=mode))
            assert (width, height) == (w, h) and got.tolist() == px


def test_webp_near_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)


def test_webp_batches_and_broken_files():
    texts = ["", "a", "é" * 500, "abc " * 3000, "".join(map(chr, range(32, 400))), "x" * 5000, *["word %d " % i * 40 for i in range(30)]]
    payloads = list(map(media.payload, texts))
    files = webp.encode_batch(payloads)
    assert webp.decode_batch(files) == payloads
    for p, f in zip(payloads, files, strict=True):  # the general decoder agrees with the one in step
        _, _, argb = webp.decode(f)
        assert np.stack([argb >> 16, argb >> 8, argb], axis=1).astype(np.uint8).tobytes() == p
    special = webp.encode(list(range(0xFF000000, 0xFF000000 + 192)), 192, [2], 4, True)
    assert webp.decode_batch([files[1], special])[0] == payloads[1]
    for bad in (b"", b"RIFF", files[3][:60], files[3][:-20]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def stored_features(file):
    """Transforms, whether there is a cache, and whether there are back-references, by the file's own header."""
    b = webp.Bits(webp.chunk(file), 8 + 28 + 4)
    if b.read(1):
        return {("predictor", "cross", "green", "palette")[b.read(2)]}
    cache = b.read(4) if b.read(1) else 0
    b.read(1)
    references = any(webp.read_lengths(b, 280 + (1 << cache if cache else 0))[256:280])
    return {k for k, there in (("cache", cache), ("references", references)) if there}


def test_every_form_competes_for_every_payload():
    r = random.Random(5)
    prose = " ".join(r.choice(["ship", "port", "of", "the", "container", "weight", "bill", "lading", "cargo"]) for _ in range(400))
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(3)) for _ in range(300)]
    near = lambda c, by: "".join(chr(min(126, max(33, c + r.randint(0, by)))) for _ in range(2))
    level, walk = [80, 80, 80], []
    for _ in range(3000):
        level = [min(122, max(40, v + r.randint(-1, 1))) for v in level]
        walk.append("".join(map(chr, level)))
    texts = {
        "references": "a line that is said again, " * 40 + prose,
        "cache": "".join(r.choice(words) for _ in range(6000)),
        "green": "".join((lambda c, n: n[0] + chr(c) + n[1])(c, near(c, 3)) for c in (r.randint(40, 120) for _ in range(3000))),
        "cross": "".join((lambda c, n: n[0] + chr(c) + n[1])(c, near(40 + c // 2, 1)) for c in (r.randint(34, 126) for _ in range(6000))),
        "predictor": "".join(walk),
        "palette": "".join(r.choice(["abc", "xyz"]) for _ in range(4000)),
    }
    payloads = [media.payload(t) for t in texts.values()]
    files = webp.encode_smallest(payloads)
    found = dict(zip(texts, map(stored_features, files), strict=True))
    assert all(k in v for k, v in found.items()), found
    assert webp.decode_batch(files) == payloads
    assert all(len(f) <= len(p) for f, p in zip(files, webp.encode_batch(payloads), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bc", "def ", "\n", "é", "€", "\x00", "zzz" * 70, "line of words ", "0123456789" * 30]), max_size=60).map("".join), min_size=1, max_size=5))
def test_smallest_files_round_trip(texts):
    payloads = list(map(media.payload, texts))
    files = webp.encode_smallest(payloads)
    assert webp.decode_batch(files) == payloads
    for p, f in zip(payloads, files, strict=True):
        _, _, argb = webp.decode(f)
        assert np.stack([argb >> 16, argb >> 8, argb], axis=1).astype(np.uint8).tobytes() == p


def test_steps_and_single_images_read_alike(monkeypatch):
    texts = [f"{'word ' * (i % 7)}{i} {'again and again ' * (i % 11)}{chr(33 + i) * 40 * i}" for i in range(60)]
    files = webp.encode_smallest(list(map(media.payload, texts)))
    for few in (0, 24, 1000):
        monkeypatch.setattr(webp, "FEW", few)
        assert webp.decode_batch(files) == list(map(media.payload, texts))
        with pytest.raises(ValueError):
            webp.decode_batch([*files[:30], webp.wrap(webp.chunk(files[59])[:-9])])


def test_features_by_plain_loops():
    payloads = [media.payload(t) for t in ("", "ship", "abc" * 500, "".join(map(chr, range(32, 400))))]
    for p, got in zip(payloads, media.features(payloads), strict=True):
        channels = [list(p[k::3]) for k in range(3)]
        want = [sum(c) / len(c) for c in channels] + [float(np.std(c)) for c in channels]
        want += [sum(abs(a - b) for a, b in zip(c, c[1:], strict=False)) / (len(c) - 1) for c in channels]
        want.append(sum(t == (255, 255, 255) for t in zip(*channels, strict=True)) / len(channels[0]))
        assert all(abs(float(a) - b) < 1e-4 for a, b in zip(got.split(), want, strict=True))


def test_tall_payloads_use_several_images(monkeypatch):
    monkeypatch.setattr(webp, "TALL", 2)
    p = [media.payload("tall " * 600), media.payload("x")]
    assert media.pixels(media.stored(p)) == p


def test_media_columns(spark):
    rows = media.read_media(media.to_media(docs(spark, ["hello", None, "", "hello", "long " * 900]))).collect()
    assert [bytes(r["pixels"]) for r in rows] == [media.payload(t) for t in ("hello", "", "", "hello", "long " * 900)]
    assert rows[0]["media"] == rows[3]["media"] and rows[0]["feature"] == rows[3]["feature"] and rows[1]["n_bytes"] == 0
    assert media.read_media(media.to_media(docs(spark, []))).count() == 0


# --- urls


def test_url_rules(spark):
    cases = ["http://A.Example.com/en/1?x#y", "https://www.example.com/en/2", "http://x.net/es/3", "http://x.net/fr", "ftp://m.y.com/q", "http://com", "http://notcom/", "nothing", None, "", "http://www.spam-farm.example.org/en/1", "http://book.example.org/en/1", "a://b.net/fr/?//c"]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")).collect()}

    def expected(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, tail = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [r for r, _ in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and tail.startswith(r[r.index("/") :])]
        return host, tail, max(fit, key=len, default=None)

    for i, url in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == expected(url)
        if got[i]["rule"]:
            assert got[i]["verdict"] == dict(urls.RULES)[got[i]["rule"]]
    assert (got[10]["verdict"], got[11]["verdict"], got[8]["verdict"]) == ("block", "allow", "allow")


def test_url_model_on_hosts_held_out():
    held = lambda r: zlib.crc32(r[0].encode()) % 5 == 0
    rows = urls.labelled_urls()
    w, b = urls.fitted([r for r in rows if not held(r)])
    scores = [(urls.score(h, p, w, b) >= 0.6, y) for h, p, y in filter(held, rows)]
    assert sum(y for _, y in scores) >= 40 and sum(1 - y for _, y in scores) >= 150
    assert sum(s for s, y in scores if y) >= 0.9 * sum(y for _, y in scores) and sum(s for s, y in scores if not y) <= 0.02 * sum(1 - y for _, y in scores)


def test_url_gradient_by_plain_loops():
    rows = [("abc.com", "/x", 1), ("abd.org", "/", 0), ("zzz.net", "/q", 0)]
    w, b = urls.fitted(rows, steps=2, rate=1.0, ridge=0.1)
    grams = [set(urls.features(h, p).tolist()) for h, p, _ in rows]
    want, bias = dict.fromkeys(set().union(*grams), 0.0), 0.0
    for _ in range(2):
        errors = [(1 / (1 + math.exp(-(sum(want[g] for g in gs) / len(gs) ** 0.5 + bias))) - y) * (0.5 if y else 0.25) for gs, (_, _, y) in zip(grams, rows, strict=True)]
        want = {g: v - sum(e / len(gs) ** 0.5 for e, gs in zip(errors, grams, strict=True) if g in gs) - 0.1 * v for g, v in want.items()}
        bias -= sum(errors)
    assert abs(b - bias) < 1e-5 and all(abs(w[g] - v) < 1e-5 for g, v in want.items()) and (w != 0).sum() <= len(want)


def test_url_model_on_unseen_hosts():
    w, b = urls.model()
    assert min(urls.score(f"www.{h}.example.org", "/en/7", w, b) for h in ("adult-video", "casino-royal", "cheap-pills-now", "ads-tracker")) >= 0.6
    assert max(urls.score(f"{h}.example.org", "/en/7", w, b) for h in ("bakery", "cooking", "mountain", "therthon", "physics")) < 0.6


# --- personal data

NAIVE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def naive_spans(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(NAIVE[0], text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(NAIVE[1], text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(NAIVE[2], text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(NAIVE[3], text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "%x", "a", "-", "1", "255", "256", "0", " ", "+1 (555) 123-4567", "+", "4111 1111 1111 1111", "4111", "-1", "é", "\n", "b.c@d", "(", ")"]), max_size=25).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == naive_spans(text)


def test_long_runs_stay_fast():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 50_000, "+1" + "(" * 200_000, "4 " * 100_000):
        pii.base_spans(text)


def test_disclosure(spark):
    filler = ["plain words without anything personal %d" % i for i in range(60)]
    named = [f"{a} xavier wrote from x@mail.com {b} yesterday" for a, b in (("one", "two"), ("three", "four"), ("five", "six"), ("seven", "nine"))]
    d = docs(spark, [*filler, *named, None, "", *["copy near c@mail.com thing"] * 6])
    rows = pii.detect(d).collect()
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    found = {texts[r["doc_id"]][s["s"] : s["e"]] for r in rows for s in r["terms"]}
    assert "xavier" in found and not found & {"plain", "words", "copy", "thing"}  # copies are one context
    assert len(rows) == d.count()
    clean = {r["doc_id"]: r for r in pii.sanitise(d).collect()}
    assert clean[60]["text"].startswith("one <TERM> ") and "<EMAIL>" in clean[60]["text"] and "xavier" not in clean[60]["text"]
    assert clean[0]["text"] == filler[0] and clean[64]["text"] is None and clean[60]["n_chars"] == len(clean[60]["text"])
    assert pii.detect(docs(spark, [])).count() == 0


def term_texts(d, **how):
    """The disclosing terms of each document, as they stand."""
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    return {r["doc_id"]: [texts[r["doc_id"]][s["s"] : s["e"]] for s in r["terms"]] for r in pii.detect(d, **how).collect()}


def test_disclosure_counts_whole_texts_and_parts_of_entities(spark):
    filler = [f"plain words number{i} of a text" for i in range(3000)]
    far = [f"Zorbax {'plain words of a text ' * 5} then card 4111 1111-1111 1111 end", f"card 4111111111111111 {'plain words of a text ' * 5} zorbax end"]
    local = [f"quimby has plain words of a text {i} plain words of a text ann.lee@mail{i}.org" for i in range(3)]
    got = term_texts(docs(spark, [*filler, *far, *local, "once only bob@host.net hapax"]))
    assert "Zorbax" in got[3000] and "zorbax" in got[3001] and all("quimby" in got[i] for i in (3002, 3003, 3004))
    assert not any(got[i] for i in range(3000)) and not got[3005]  # one text is no evidence


def test_disclosing_terms_are_marked_wherever_they_stand(spark):
    filler = [f"plain words number{i} of a text" for i in range(3000)]
    named = [f"the xavier {i} wrote {'plain words of a text ' * 9} to x@mail.com" for i in range(40)]
    d = docs(spark, [*filler, *named, f"no entity here {'plain words of a text ' * 50} (XAVIER) xavier"])
    assert term_texts(d)[3040] == ["XAVIER", "xavier"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(d).collect()}
    assert clean[3040].endswith("(<TERM>) <TERM>") and "xavier" not in clean[3005]


def test_copies_change_no_verdict(spark):
    named = [f"xavier {a} wrote to x@mail.com" for a in ("one", "two", "three", "four", "five")]
    texts = [*(f"plain words number{i}" for i in range(300)), *named]
    once, copied = (term_texts(docs(spark, [*texts, *named[:1] * n])) for n in (0, 1000))
    assert all("xavier" in once[i] and once[i] == copied[i] for i in range(300, 305)) and copied[305] == copied[1304] == once[300]


def test_a_task_holds_one_worker(spark, monkeypatch):
    plans, write = [], pii.materialise
    monkeypatch.setattr(pii, "materialise", lambda df, name: plans.append(df) or write(df, name))
    named = [f"xavier {a} wrote to x@mail.com" for a in ("one", "two", "three", "four", "five")]
    d = docs(spark, [*(f"plain words number{i}" for i in range(300)), *named, *named[:1] * 3])
    plans.append(pii.detect(d))
    assert len(plans) == 5
    for df in plans:
        above = []  # nodes from the root to a line of the plan
        for line in df._jdf.queryExecution().executedPlan().treeString().splitlines():
            at = re.search("[A-Z]", line).start()
            above = [x for x in above if x[0] < at] + [(at, line[at:])]
            stage = re.split(r"\bExchange\b", " ".join(re.match(r"\w+", x)[0] for _, x in above))[-1]
            assert len(re.findall("MapInArrow|ArrowEvalPython", stage)) < 2, (stage, line)


def test_overlapping_spans_are_masked_whole():
    assert pii.masked("at 192.168.0.1@host.com now", []) == "at <EMAIL> now" and pii.masked("+1 555 0100.ann@x.com", []) == "<PHONE>"
    assert "@" not in pii.masked("x 10.0.0.1@h.org, +1 555 0100 22.b@y.org", []) and pii.masked("a b", [(0, 1)]) == "<TERM> b"


# --- language and toxicity


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = langid.identify(d, ["doc_id", "lang"]).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95
    net = langid.fit(d)
    odd = {r["doc_id"]: r for r in langid.identify(docs(spark, [None, "", "123 !!", "der", "the cat " * 5000, "²³Ⅷ"]), net=net).collect()}
    assert [odd[i]["lang_pred"] for i in (0, 1, 2, 5)] == ["und"] * 4 and odd[0]["score"] == 0 and odd[4]["lang_pred"] == "en" and odd[3]["lang_pred"] in net.classes
    assert langid.fit(docs(spark, [])) is None and langid.identify(docs(spark, [])).count() == 0


def test_byte_tables_equal_the_filters():
    net = langid.ByteNet(["a", "b"])
    x, _ = langid.windows([b"some text", b"x" * 700])
    emb = net.embed[x]
    h = []
    for w, f in zip(langid.WIDTHS, net.filters, strict=True):
        view = np.stack([emb[:, i : i + w].reshape(len(x), -1) for i in range(x.shape[1] - w + 1)], axis=1)
        h.append((view @ f).max(axis=1))
    want = langid.softmax(np.maximum(np.concatenate(h, axis=1) + net.bias, 0) @ net.out + net.out_bias)
    assert np.allclose(net.probabilities(x, net.tables()), want, atol=1e-4)


def test_toxicity(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ne", "ru", "ta"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        text = ["the", "of", *(word() for _ in range(r.randint(5, 80)))]
        if bad:
            text.insert(r.randrange(len(text)), r.choice(["idiot", "moron", "zgorfen", "zgoran"]))
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    d, l = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(d, l).collect()
    held = [x for x in got if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) and x["predicted"] == int(x["score"] >= 0.7) and 0 <= x["score"] <= 1 for x in got)
    assert np.mean([x["predicted"] == int(x["doc_id"] % 5 == 0) for x in held]) >= 0.97
    net = toxicity.fit(d, l)
    odd = [x["score"] for x in toxicity.score_toxicity(docs(spark, [None, "", " ", "idiot", "IDIOT!"]), l, net).orderBy("doc_id").collect()]
    assert odd[0] == odd[1] == odd[2] < 0.7 <= odd[3] and odd[3] == odd[4]
    assert toxicity.fit(d, l.where("toxic = 1")) is None


def test_rare_language_is_learnt(spark):
    r = random.Random(1)
    text = lambda words: " ".join(r.choice(words) for _ in range(30))
    rows = [(i, text(["the", "quick", "brown", "fox", "of"]), "en", "s", 1) for i in range(12_000)] + [(20_000 + i, text(["žluť", "kůň", "příliš", "úpěl"]), "cs", "s", 1) for i in range(3)]
    d = spark.createDataFrame(rows, DOCS)
    got = langid.identify(d.where("doc_id >= 20000"), net=langid.fit(d)).collect()
    assert [x["lang_pred"] for x in got] == ["cs"] * 3


def test_toxicity_learns_from_whole_texts(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ne", "ru", "ta"]) for _ in range(r.randint(2, 4)))
    rows, labels = [], []
    for i in range(900):
        text = ["the", "of", *(word() for _ in range(620)), *(["zgorfen"] if i % 3 == 0 else []), "end"]  # behind 3,000 characters
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(i % 3 == 0)))
    d, l = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = [x for x in toxicity.score_toxicity(d, l).collect() if x["held_out"]]
    assert np.mean([x["predicted"] == int(x["doc_id"] % 3 == 0) for x in held]) >= 0.97


def test_toxicity_learns_from_every_labelled_row(spark):
    ids = [r[0] for r in spark.range(9000).where("crc32(cast(cast(id as string) as binary)) % 3 <> 1").orderBy("id").selectExpr("id").collect()]
    last = {r[0] for r in spark.range(9000).where("crc32(cast(cast(id as string) as binary)) % 3 <> 1 and id % 2 = 0").selectExpr("id", "xxhash64(id) as h").orderBy("h", ascending=False).limit(120).collect()}
    r = random.Random(8)
    text = lambda *more: " ".join(["the", "of", *(r.choice(["kalo", "mine", "ruta", "lomi"]) for _ in range(6)), *more])
    rows = [(i, text("zgorfen") if i in last else text("idiot") if i % 2 == 0 else text()) for i in ids]
    odd = [(20_000 + i, text("zgorfen") if i % 2 else text()) for i in range(100)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows + odd], DOCS)
    l = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    net = toxicity.fit(d, l)
    assert net.rows == len(rows)
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score_toxicity(d.where("doc_id >= 20000"), l, net).collect()}
    assert np.mean([got[i] == i % 2 for i, _ in odd]) >= 0.97
    again = toxicity.fit(d.repartition(5), l.union(l))
    assert np.allclose(again.embed, net.embed, atol=1e-5) and again.rows == net.rows


# --- quality


def brute_base(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    repeat = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


def shannon(p, q):
    p, q = np.array(p) / sum(p), np.array(q) / sum(q)
    k = lambda a: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, q if a is p else p, strict=True) if x)
    return math.sqrt(max((k(p) + k(q)) / 2, 0))


def test_quality(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    d = d.union(spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "a b a b a b c " * 40, "xx", "s", 0), (-3, "x\n \nx\ny", "en", "s", 0), (-4, "é\u00a0ß \x0bq", "de", "s", 0)], DOCS))
    texts = Counter((r["doc_id"], *brute_base(r["text"])) for r in d.collect())
    rows = quality.judge(d).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == texts
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)
    m = quality.measures(d).where("lang = 'en'").collect()
    sums = lambda c: [sum(r[c][i] or 0 for r in m) for i in range(len(m[0][c]))]
    classes, common = sums("classes"), sums("common")
    got = {r["doc_id"]: r for r in rows}
    for r in m[:60]:
        g = got[r["doc_id"]]
        if g["class_distance"] is not None:
            assert abs(g["class_distance"] - shannon(r["classes"], classes)) < 1e-5
        if g["word_distance"] is not None:
            assert abs(g["word_distance"] - shannon(r["common"], common)) < 1e-5
    assert quality.judge(docs(spark, [])).count() == 0


def test_quality_where_window_hashes_clash(spark, monkeypatch):
    """With few bits for the hash, unlike windows interleave among equal ones; with few for the place, texts have too many places."""
    r = random.Random(9)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (50, 300, 1500)] + ["x y z " * 400, " ".join(map(str, range(900))), "long " * 30_000 + "end"]
    for place in (62, 4):
        monkeypatch.setattr(quality, "PLACE", place)
        got = {x["doc_id"]: x["n_repeat_words"] for x in quality.measures(docs(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == [brute_base(t)[4] for t in texts]


def test_quality_says_what_the_references_hold(spark):
    rows = quality.judge(docs(spark, ["word " * 60, None])).collect()
    assert {x["reference_words"] for x in rows} == {60} and all(x["class_distance"] is None for x in rows)


# --- media: the encoder's choice, the columns, damaged files


def test_repetitive_texts_are_stored_with_references():
    r = random.Random(3)
    texts = ["", "same line of text, again and again\n" * 300, "ab" * 4000, "z", "".join(r.choice("abcdefghijklmnop ") for _ in range(6000)), ("x%d " % 5) * 3000 + "tail"]
    payloads = list(map(media.payload, texts))
    plain, files = webp.encode_batch(payloads), webp.encode_smallest(payloads)
    assert webp.decode_batch(files) == payloads
    assert all(len(f) <= len(p) for f, p in zip(files, plain, strict=True)) and [f != p for f, p in zip(files, plain, strict=True)] == [False, True, True, True, False, True]  # one colour: the plain code has no bits at all
    assert len(files[1]) * 10 < len(plain[1])


def test_damaged_plain_files_are_errors():
    payloads = [media.payload("".join(map(chr, range(33, 120))) * 60), media.payload("second text, quite another one")]
    files = webp.encode_batch(payloads)
    for cut in (3, 60, 200):
        body = files[0][20:-cut]
        with pytest.raises(ValueError):
            webp.decode_batch([webp.wrap(body), files[1]])
        with pytest.raises(ValueError):
            webp.decode_batch([webp.wrap(body)])


def test_media_query_columns(spark, tmp_path):
    import hashlib

    from shipcheck.llm import queries

    texts = ["hello", None, "", "é" * 700, "hello", "line\n" * 2000, "\u0000 nul"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5_webp_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        p = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        stored = webp.encode_smallest([p])[0]
        want = (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert tuple(got[i][c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")) == want
    assert got[0]["feature"] == got[4]["feature"]


# --- toxicity: the network against plain loops, gradients, thresholds


def tiny_texts(n, seed=2):
    r = random.Random(seed)
    words = toxicity.Words()
    return [toxicity.codes(" ".join(r.choice(["the", "of", "ka", "lomi", "zgorf", "neru", "x"]) for _ in range(r.randint(1, 9))), words) for _ in range(n)]


def test_convolution_equals_plain_loops():
    net, texts = toxicity.WordNet(), tiny_texts(12)
    want = []
    for t in texts:
        emb = [net.embed[c & (toxicity.ROWS - 1)] + net.embed[toxicity.ROWS + ((c >> 15) & (toxicity.ROWS - 1))] for c in t.tolist()]
        emb += [np.zeros(toxicity.EMBED, np.float32)] * (max(toxicity.WIDTHS) - 1)
        h = [max(sum(float(emb[at + k] @ f[k * toxicity.EMBED : (k + 1) * toxicity.EMBED, j]) for k in range(w)) for at in range(len(t))) for w, f in zip(toxicity.WIDTHS, net.filters, strict=True) for j in range(toxicity.FILTERS)]
        want.append(float(np.maximum(np.array(h) + net.bias, 0) @ net.out + net.out_bias[0]))
    assert np.allclose(net.logits(np.concatenate(texts), np.array([len(t) for t in texts])), want, atol=1e-4)


def test_training_lowers_the_loss_and_thresholds_part_the_labels():
    words, net = toxicity.Words(), toxicity.WordNet()
    r = random.Random(8)
    texts = [toxicity.codes(" ".join([r.choice(["the", "of", "ka", "lo"]) for _ in range(8)] + (["zgorfen"] if i % 2 else ["mine"])), words) for i in range(200)]
    y = np.array([i % 2 for i in range(200)], np.float32)
    loss = lambda: float(np.mean(np.logaddexp(0, net.logits(np.concatenate(texts), np.array([len(t) for t in texts])) * (1 - 2 * y))))
    before = loss()
    net.train(texts, y)
    assert loss() < before / 2
    net.calibrate(texts, y)
    assert all((s >= toxicity.LEVEL) == bool(v) for s, v in zip(net.scores(texts), y, strict=True))


# --- odd tables


def test_odd_tables_of_row_operators(spark):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (2, 1, 0), (None, None, None), (9, 0, 5)], "doc_id long, quality int, toxic int")
    rows = [(1, "bad zgorf", "en", "s", 1), (1, "bad zgorf", "en", "s", 1), (2, "good text", None, None, None), (None, "no id", None, None, None), (3, "w " * 200_000, "en", "s", 1)]
    d = spark.createDataFrame([(*x, "clash", 7) for x in rows], DOCS + ", score string, held_out int")
    assert toxicity.score_toxicity(d, labels).count() == 5 and toxicity.score_toxicity(d.where("false"), labels).count() == 0 and toxicity.score_toxicity(d, labels.where("false")).count() == 5
    assert langid.identify(d).count() == 5 and langid.identify(d.where("lang is null")).count() == 2
    assert quality.judge(d.withColumnsRenamed({"score": "n_words", "held_out": "kept"})).count() == 5
    assert pii.detect(d.withColumnsRenamed({"score": "spans", "held_out": "terms"})).count() == 5
    pages = spark.createDataFrame([(1, "http://a.net/es/1", "x", "r"), (1, "http://a.net/es/1", "x", "r"), (None, None, None, None), (2, "http://" + "a" * 50_000, None, "r")], "page_id long, url string, rule string, verdict string")
    got = urls.filter_urls(pages).collect()
    assert len(got) == 4 and [x["verdict"] for x in got if x["page_id"] == 1] == ["block"] * 2 and urls.filter_urls(pages.where("false")).count() == 0
