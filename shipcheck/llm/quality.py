"""Quality rules by distribution divergence, in DataFrame operations alone: a document's
character-class and common-word histograms against its language's, by Jensen-Shannon distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Common words of each language whose shares make up the word histogram.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "was", "that", "for", "it", "with", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "nicht", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
}
#: Production parameters: greatest class distance of short and of longer documents, greatest word distance;
#: least words of any comparison, of a longer document, and of a reference.
SHORT_LIMIT, CLASS_LIMIT, WORD_LIMIT, CLASS_WORDS, WORD_WORDS, REFERENCE_WORDS = 0.26, 0.18, 0.25, 50, 150, 20_000
WS = r"[\x20\x09-\x0D]+"
#: Bits of a packed number that hold a window's place; longer texts take the exact sort at once.
PLACE = 24


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, base measures and both histograms, one row per row of docs."""
    d = docs.select("doc_id", "lang", "text").withColumn("_t", F.coalesce("text", F.lit("")))
    d = d.withColumn("_w", F.array_remove(F.split("_t", WS), "")).withColumn("_n", F.size("_w"))
    # hash of each 3-word window; texts without an equal pair (most) need no sorting
    d = d.withColumn("_tri", F.expr("case when _n >= 3 then slice(transform(_w, (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2))), 1, _n - 2) else cast(array() as array<bigint>) end"))
    # hashes and places sorted as single numbers; neighbours are compared in full.  Where a window has a neighbour with the
    # same top bits but another hash, and in texts with too many places, the whole hashes are sorted instead
    mask = (1 << PLACE) - 1
    d = d.withColumn("_packed", F.expr(f"case when _n <= {mask} and size(array_distinct(_tri)) < size(_tri) then sort_array(transform(_tri, (h, i) -> (h & {~mask}L) | i)) else cast(array() as array<bigint>) end"))
    near = lambda a, b: f"(({a} | {mask}L) = ({b} | {mask}L))"
    same = lambda a, b: f"({near(a, b)} and get(_tri, cast({a} & {mask}L as int)) = get(_tri, cast({b} & {mask}L as int)))"
    either = lambda test: f"(coalesce({test('x', 'get(_packed, i - 1)')}, false) or coalesce({test('x', 'get(_packed, i + 1)')}, false))"
    d = d.withColumn("_seen", F.expr(f"transform(_packed, (x, i) -> if({either(same)}, x & {mask}L, if({either(near)}, -2L, -1L)))"))
    d = d.withColumn("_rows", F.expr(f"case when _n > {mask} or array_contains(_seen, -2L) then array_sort(transform(_tri, (h, i) -> named_struct('h', h, 'i', cast(i as bigint)))) end"))
    exact = "transform(_rows, (x, i) -> if(coalesce(x.h = get(_rows, i - 1).h, false) or coalesce(x.h = get(_rows, i + 1).h, false), x.i, -1L))"
    d = d.withColumn("_at", F.expr(f"sort_array(filter(coalesce({exact}, _seen), p -> p >= 0))"))
    lines = F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')")
    d = d.withColumn("_lines", lines)
    chars = F.length("_t")
    word_chars = F.length(F.array_join("_w", ""))
    without = lambda pattern: F.length(F.regexp_replace("_t", pattern, ""))
    upper, lower, digit = chars - without(r"\p{Lu}+"), chars - without(r"\p{Ll}+"), chars - without(r"\p{Nd}+")
    mark = chars - without(r"\p{P}+")
    d = d.withColumn("_s", F.concat(F.lit("  "), F.lower(F.regexp_replace("_t", r"[^\p{L}]+", "  ")), F.lit("  ")))
    count = lambda w: ((F.length("_s") - F.length(F.replace(F.col("_s"), F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2)).cast("long")
    words = F.when(F.lit(False), F.array(*[F.lit(0).cast("long")] * 12))
    for lang, vocabulary in COMMON.items():
        words = words.when(F.col("lang") == lang, F.array(*map(count, vocabulary)))
    d = d.select(
        "doc_id", "lang",
        F.col("_n").cast("long").alias("n_words"), word_chars.cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("cast(aggregate(transform(_at, (p, i) -> if(i = 0, 3L, least(3L, p - get(_at, i - 1)))), 0L, (a, b) -> a + b) as bigint)").alias("n_repeat_words"),
        F.array(*[c.cast("long") for c in (upper, lower, digit, mark, chars - word_chars)]).alias("_cls"), chars.cast("long").alias("_chars"), words.alias("_com"),
    )
    other = F.greatest(F.col("_chars") - F.expr("aggregate(_cls, 0L, (a, b) -> a + b)"), F.lit(0).cast("long"))
    rest = F.greatest(F.col("n_words") - F.expr("aggregate(_com, 0L, (a, b) -> a + b)"), F.lit(0).cast("long"))
    return d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.concat("_cls", F.array(other)).alias("classes"), F.concat("_com", F.array(rest)).alias("common"))


def distance(p: str, q: str) -> str:
    """SQL of the Jensen-Shannon distance (base 2) of two count arrays; null if one is null or sums to 0."""
    total = lambda a: f"aggregate({a}, 0L, (s, v) -> s + v)"
    term = "if(x.a > 0, x.a * log2(2 * x.a / (x.a + x.b)), 0d) + if(x.b > 0, x.b * log2(2 * x.b / (x.a + x.b)), 0d)"
    shares = f"zip_with({p}, {q}, (u, v) -> named_struct('a', u / cast(_pt as double), 'b', v / cast(_qt as double)))"
    body = f"sqrt(greatest(aggregate({shares}, 0d, (s, x) -> s + {term}) / 2, 0d))"
    return f"case when {p} is not null and {q} is not null and {total(p)} > 0 and {total(q)} > 0 then {body.replace('_pt', total(p)).replace('_qt', total(q))} end"


def references(m: DataFrame) -> DataFrame:
    """Per language the sums of both histograms over all documents."""
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)])
    return m.groupBy("lang").agg(F.sum("n_words").alias("_rw"), sums("classes", 6).alias("_rc"), sums("common", 13).alias("_rm")).withColumnRenamed("lang", "_rl")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance and reference_words for every row of docs.

    kept: the base rules hold and neither distance is over its limit.  Guards: classes are compared
    from CLASS_WORDS words on, common words from WORD_WORDS on and in the listed languages only,
    both only with references of REFERENCE_WORDS words (reference_words shows what the language has; a
    smaller one tells nothing, and its documents are kept by the base rules alone).  A null language is a language of its own;
    null texts are empty (and fail the base rules).  Texts are read once; the measures (no texts)
    are written to the shared folder, summed per language, and judged."""
    m = materialise(measures(docs), "measures")
    m = m.join(references(m), F.col("lang").eqNullSafe(F.col("_rl")), "left")
    enough = lambda least: (F.col("n_words") >= least) & (F.col("_rw") >= REFERENCE_WORDS)
    m = m.withColumn("class_distance", F.when(enough(CLASS_WORDS), F.expr(distance("classes", "_rc")))).withColumn("word_distance", F.when(enough(WORD_WORDS), F.expr(distance("common", "_rm"))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = F.coalesce(F.col("class_distance") <= F.when(F.col("n_words") < WORD_WORDS, SHORT_LIMIT).otherwise(CLASS_LIMIT), F.lit(True)) & F.coalesce(F.col("word_distance") <= WORD_LIMIT, F.lit(True))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"), F.col("_rw").alias("reference_words"))
