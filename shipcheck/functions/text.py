"""Text functions as Column expressions; Python workers only for Unicode compatibility folding.

Every value that is used more than once is bound by `let`, so that an expression holds it once and
Spark computes it once: plans stay small and generated code compiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .. import vocab

#: All white space that Unicode knows, as a Java character class and as a string.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_LONG_FOLDS = "[" + "".join(a for a, _ in vocab.FOLD_PAIRS) + "]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_only(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def by_text(c: Column, pattern: str, test: Callable[[str], Column]) -> Column:
    """test(pattern), for a pattern that begins with (?iU) or (?U): over ASCII without the U, which changes nothing there and costs a multiple."""
    return F.when(ascii_only(c), test(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))).otherwise(test(pattern))


def matches(c: Column, pattern: str) -> Column:
    return by_text(c, pattern, c.rlike)


def fold(c: Column) -> Column:
    """Case-folded ASCII letters and digits, single-spaced: what the rules match against."""
    pairs = F.expr("array(" + ", ".join(f"struct('{a}' as a, '{b}' as b)" for a, b in vocab.FOLD_PAIRS) + ")")
    letters = lambda x: F.when(~ascii_only(x) & x.rlike(_LONG_FOLDS), F.aggregate(pairs, x, lambda out, p: F.replace(out, p["a"], p["b"]))).otherwise(x)
    return F.trim(F.regexp_replace(F.lower(let(c, letters)), "[^a-z0-9]+", " "))


def padded(folded: Column) -> Column:
    return F.concat(F.lit(" "), folded, F.lit(" "))


def texts(values: list[str]) -> Column:
    """An array of literals, as one expression."""
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def _words(terms: list[str]) -> Column:
    """The terms as they stand in padded text, padded once and not for every row."""
    return texts([f" {t} " for t in terms])


def found(text: Column, terms: list[str]) -> Column:
    """The terms that stand in padded text as whole words, in the order of the list."""
    return F.transform(F.filter(_words(terms), lambda t: F.contains(text, t)), lambda t: F.trim(t))


def has_term(folded: Column, terms: list[str]) -> Column:
    """Whether any of the terms stands in folded text as whole words."""
    return let(padded(folded), lambda text: F.exists(_words(terms), lambda t: F.contains(text, t)))


def hits(folded: Column, terms: list[str]) -> Column:
    """The terms found, in the order of the list."""
    return let(padded(folded), lambda text: found(text, terms))


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; empty is null."""
    return let(F.trim(F.regexp_replace(c, SPACE + "+", " ")), lambda t: F.nullif(t, F.lit("")))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def lines(c: Column) -> Column:
    return F.split(c, "\r\n|\r|\n")


# --- Unicode forms: struct(t: compatibility form, f: without accents, case-folded)

_FORMS = ArrayType(StructType([StructField("t", StringType()), StructField("f", StringType())]))
_ARROW_FORMS = pa.list_(pa.struct([("t", pa.string()), ("f", pa.string())]))


def _folded(v: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).casefold()


@F.arrow_udf(_FORMS)
def _unicode_forms(values: pa.Array) -> pa.Array:
    """Of structs of strings; a struct crosses to the worker far faster than an array does."""
    if values.null_count == len(values):
        return pa.nulls(len(values), _ARROW_FORMS)
    one = lambda v: None if v is None else {"t": unicodedata.normalize("NFKC", v), "f": _folded(v)}
    return pa.array([None if vs is None else [one(v) for v in vs.values()] for vs in values.to_pylist()], _ARROW_FORMS)


def forms(values: list[Column], unicode: bool | str = True) -> Column:
    """An array of both forms of each value.  Where all are ASCII they stay in the JVM: workers see nulls for them.

    unicode=False is the form without Python, for values known to be ASCII; a text names the registered function that makes the others."""
    plain = F.array(*[F.when(v.isNotNull(), F.struct(v.alias("t"), F.lower(v).alias("f"))) for v in values])
    if not unicode:
        return plain
    other = F.concat_ws("", *values).rlike(r"[^\x00-\x7F]")
    made = (lambda c: F.call_function(unicode, c)) if isinstance(unicode, str) else _unicode_forms
    return F.when(~other, plain).otherwise(made(F.when(other, F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))))


def _with_form(c: Column, unicode: bool, rule: Callable[[Column, Column], Column]) -> Column:
    """rule(value, its forms) for one column."""
    return let(F.struct(c.alias("v"), F.get(forms([c], unicode), F.lit(0)).alias("x")), lambda y: rule(y["v"], y["x"]))


# --- the rules, on a value and its forms


def placeholder_rule(v: Column, x: Column) -> Column:
    return v.isNull() | let(strip(x["t"]), lambda t: (t == "") | matches(t, vocab.PLACEHOLDER))


def _map(pairs: dict) -> Column:
    return F.expr("map(" + ", ".join(f"'{x}'" for kv in pairs.items() for x in kv) + ")")


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def text_rule(v: Column, x: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.replace(x["f"], F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " ")), " ")
    legal = F.transform(words, lambda w: F.coalesce(F.try_element_at(_map(vocab.LEGAL_WORDS), w), w))
    return F.when(~placeholder_rule(v, x), let(F.array_join(legal, " "), _some))


def party_rule(v: Column, x: Column) -> Column:
    return let(text_rule(v, x), lambda t: F.when(t.isin(vocab.SAME_AS_CONSIGNEE), vocab.CONSIGNEE_MARK).when(t.isin(vocab.SAME_AS_SHIPPER), vocab.SHIPPER_MARK).otherwise(t))


def port_rule(v: Column, x: Column) -> Column:
    ports = _map(vocab.PORT_ALIASES)
    codes = texts([k for k in vocab.PORT_ALIASES if len(k) == 5])
    alias = lambda t: F.coalesce(F.try_element_at(ports, t), F.try_element_at(ports, F.replace(t, F.lit(" "), F.lit(""))))
    named = lambda t: F.array_join(F.filter(F.split(t, " "), lambda w: ~F.array_contains(codes, w)), " ")
    by_name = lambda t: let(named(t), lambda n: F.when(n != "", F.coalesce(alias(n), n)))
    by_code = lambda t: F.try_element_at(ports, F.get(F.filter(F.split(t, " "), lambda w: F.array_contains(codes, w)), F.lit(0)))
    return let(text_rule(v, x), lambda t: F.coalesce(alias(t), by_name(t), by_code(t), t))


def decimal_from_text(c: Column) -> Column:
    """A number with any of the usual groupings as decimal(38,10); null if it isn't one."""
    drop = lambda t, what: F.replace(t, F.lit(what), F.lit(""))
    point = lambda t: F.replace(t, F.lit(","), F.lit("."))
    tail = lambda t, mark: F.length(F.substring_index(t, mark, -1))

    def plain(t: Column) -> Column:
        comma, dot = t.contains(","), t.contains(".")
        return (
            F.when(comma & dot, F.when(tail(t, ",") < tail(t, "."), point(drop(t, "."))).otherwise(drop(t, ",")))
            .when(comma, F.when(tail(t, ",") == 3, drop(t, ",")).otherwise(point(t)))
            .when(dot & (tail(t, ".") == 3) & (F.length(t) - F.length(drop(t, ".")) == 1), drop(t, "."))
            .otherwise(t)
        )

    return let(F.replace(strip(c), F.lit(" "), F.lit("")), plain).try_cast("decimal(38,10)")


def weight_rule(v: Column, x: Column) -> Column:
    """The whole run of digits, marks and white space is the number: one with other blanks than spaces inside is none."""
    amount = lambda raw: decimal_from_text(by_text(raw, vocab.WEIGHT_NUMBER, lambda p: F.regexp_extract(raw, p, 0)))

    def unit(low: Column) -> Column:
        out = F.when(matches(low, vocab.WEIGHT_UNITS[0][1]), vocab.WEIGHT_UNITS[0][0])
        for name, pattern in vocab.WEIGHT_UNITS[1:]:
            out = out.when(matches(low, pattern), name)
        return out.otherwise("kg")

    def kilograms(p: Column) -> Column:
        tons, pounds = p["amount"] * F.lit(1000).cast("decimal(4,0)"), p["amount"].cast("decimal(27,10)") * F.lit(vocab.POUND_KG).cast("decimal(9,8)")
        kg = F.when(p["unit"] == "kg", p["amount"]).when(p["unit"] == "mt", tons).when(p["unit"] == "lb", pounds)
        return F.when(p["amount"] >= 0, F.regexp_replace(F.round(kg, 3).cast("decimal(38,3)").cast("string"), r"\.?0+$", ""))

    parts = lambda raw: F.struct(amount(raw).alias("amount"), let(F.lower(raw), unit).alias("unit"))
    return F.when(~placeholder_rule(v, x), let(let(strip(v), parts), kilograms))


def containers_rule(v: Column, x: Column) -> Column:
    def count(low: Column) -> Column:
        add = lambda s, n: (s + n.cast("decimal(37,0)")).cast("decimal(38,0)")
        total = let(F.regexp_extract_all(low, F.lit(vocab.CONTAINER_PARTS), 1), lambda p: F.when(F.size(p) > 0, F.aggregate(p, F.lit(0).cast("decimal(38,0)"), add).cast("string")))
        explicit, bare = let(F.regexp_extract(low, vocab.CONTAINER_TOTAL, 1), _some), F.when(low.rlike("^[0-9]+$"), low)
        number = let(F.coalesce(total, explicit, bare), lambda n: F.when(n.isNotNull(), F.coalesce(_some(F.ltrim(n, F.lit("0"))), F.lit("0"))))
        return F.coalesce(F.try_element_at(_map({k: str(n) for k, n in vocab.NUMBER_WORDS.items()}), low), number)

    return F.when(~placeholder_rule(v, x), let(F.lower(strip(v)), count))


# --- the same for one column


def is_placeholder(c: Column, unicode: bool = True) -> Column:
    return _with_form(c, unicode, placeholder_rule)


def normalize_text(c: Column, unicode: bool = True) -> Column:
    """Case, accents, punctuation and legal forms made alike; placeholders are null."""
    return _with_form(c, unicode, text_rule)


def normalize_party(c: Column, unicode: bool = True) -> Column:
    return _with_form(c, unicode, party_rule)


def normalize_port(c: Column, unicode: bool = True) -> Column:
    """A port's name; known codes beside a name are dropped, codes alone are looked up."""
    return _with_form(c, unicode, port_rule)


def normalize_weight(c: Column, unicode: bool = True) -> Column:
    """Kilograms as text without trailing zeros; ambiguous units, negative amounts and amounts of over 28 digits are null."""
    return _with_form(c, unicode, weight_rule)


def normalize_containers(c: Column, unicode: bool = True) -> Column:
    """Total number of containers as text."""
    return _with_form(c, unicode, containers_rule)


# --- attachments and display


def usable(c: Column) -> Column:
    """Eight ASCII letters or digits at least."""
    return F.length(F.regexp_replace(c, "[^A-Za-z0-9]+", "")) >= 8


def replacement_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, (F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))) / F.length(c)).otherwise(0.0)


def suffix(filename: Column) -> Column:
    """The lower-cased last suffix; names that only begin or end with a dot have none."""
    return F.lower(F.regexp_extract(F.regexp_extract(filename, r"([^/]*)$", 1), r"[^.].*?(\.[^./]+)$", 1))


def readable(content: Column, ext: Column) -> Column:
    """Plain text: a known suffix, not blank, no NUL, under one replacement character in twenty."""
    return ~ext.isin(vocab.UNREADABLE_SUFFIXES) & (strip(content) != "") & ~content.contains("\x00") & (replacement_ratio(content) < 0.05)


def display(c: Column, width: int | None = None, none: str = "—") -> Column:
    """One line of text, cut to `width` with an ellipsis; null as `none`."""
    shown = F.coalesce(F.trim(F.regexp_replace(c, SPACE + "+", " ")), F.lit(none))
    return shown if width is None else let(shown, lambda s: F.when(F.length(s) > width, F.concat(F.left(s, F.lit(width - 1)), F.lit("…"))).otherwise(s))


def cell(c: Column, width: int) -> Column:
    """A table cell: displayed, cut and filled to `width`."""
    return F.rpad(display(c, width), width, " ")


def joined(c: Column, none: str = "-") -> Column:
    """The items of an array, each on one line, joined by `; `; `none` if there are none."""
    return F.coalesce(_some(F.array_join(F.transform(F.array_compact(c), lambda x: let(display(x, none=none), lambda s: F.when(s == "", none).otherwise(s))), "; ")), F.lit(none))


def source_format(filename: Column, given: Column) -> Column:
    """The format that was recorded, else the suffix in capitals, else UNKNOWN."""
    return F.coalesce(_some(given), _some(F.upper(F.substring(suffix(filename), 2, 1 << 20))), F.lit("UNKNOWN"))


def extraction_method(filename: Column, given: Column) -> Column:
    """How the text was got: as recorded, else `plain text` for .txt and `unavailable` for all others."""
    return F.coalesce(_some(given), F.when(suffix(filename) == ".txt", "plain text"), F.lit("unavailable"))


def humanize(c: Column) -> Column:
    """`missing_value` as `Missing Value`: every word's first letter in capitals, all else as it is."""
    words = lambda s: F.array_join(F.transform(F.split(s, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))), " ")
    return F.coalesce(words(F.replace(_some(c), F.lit("_"), F.lit(" "))), F.lit("—"))


def show_number(c: Column) -> Column:
    return F.format_number(c, 0)


def show_duration(seconds: Column) -> Column:
    """Milliseconds below a second, else seconds to two places."""
    return F.when(seconds < 1, F.concat(F.floor(seconds * 1000 + 0.5).cast("string"), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.2f", seconds), F.lit(" s")))


def show_bytes(n: Column) -> Column:
    """Whole KB below a megabyte, else MB to two places; null as a dash."""
    small, large = F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB")), F.concat(F.format_string("%.2f", n / 1048576), F.lit(" MB"))
    return F.when(n.isNull(), "—").when(n < 1048576, small).otherwise(large)


def show_date(epoch: Column) -> Column:
    """A time in seconds as `Nov 3, 2025, 4:05 PM`, in the session's time zone; null or 0 as a dash."""
    return F.when(epoch != 0, F.date_format(F.timestamp_seconds(epoch), "MMM d, yyyy, h:mm a")).otherwise("—")


def current_body(body: Column) -> Column:
    """The lines before a quoted thread begins."""

    def before(every: Column) -> Column:
        at = F.array_position(F.transform(every, lambda l: matches(l, vocab.THREAD_BOUNDARY)), True)
        return let(at, lambda a: F.array_join(F.when(a > 0, F.slice(every, F.lit(1), (a - 1).cast("int"))).otherwise(every), "\n"))

    return let(lines(F.coalesce(body, F.lit(""))), before)
