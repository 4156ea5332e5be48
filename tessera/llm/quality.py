"""Quality rules by distribution divergence, in DataFrame operations alone.

Each document's histogram of character classes and of common words is compared to
that of its language by Jensen-Shannon distance (base 2, 0 to 1).  References are
counted over all documents of the language; languages with too few words, and
documents without one, are held against the reference of all documents.  Documents
shorter than a minimum are not judged by a histogram, which their length makes noisy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ._shared import persist

SPACE = "[\\x20\\x09-\\x0D]+"
#: Character classes: patterns of one character of each, lower-case letters apart (fixed, in this order).
CLASSES = {"upper": "\\p{Lu}", "digit": "\\p{N}", "punct": "[.,;:!?'\"()-]", "letter": "[\\p{L}&&[^\\p{Lu}\\p{Ll}]]"}
SYMBOLS = "[#*$%&|<>]"
ALL = "*"
NAMES = [*(f"c_{k}" for k in CLASSES), "c_lower"]


@dataclass(frozen=True)
class Limits:
    """min_words: fewer fail.  max_repeat_pct: words in repeated windows.  min_chars and
    min_common: guards, in word characters and common words, below which a histogram
    is not judged.  max_char_js, max_word_js: largest distances.  max_languages: so many
    references are held by the driver; those of further languages stay a table."""

    min_words: int = 20
    max_repeat_pct: int = 30
    window: int = 8
    min_chars: int = 200
    min_judged_words: int = 50
    max_char_js: float = 0.35
    max_word_js: float = 0.75
    n_common: int = 40
    min_reference_words: int = 2000
    max_languages: int = 64


def words_of(text: Column) -> Column:
    """Words: stretches without ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def window_hashes(hashes: Column, width: int, n: Column) -> Column:
    """Hash of every window of ``width`` (a power of two) of n words, by doubling: the
    hash of a window and of the one after it make that of both."""
    step = 1
    while step < width:
        hashes = _doubled(hashes, step)
        step *= 2
    return F.slice(hashes, 1, F.greatest(n - (width - 1), F.lit(0)).cast("int"))


def _doubled(hashes: Column, step: int) -> Column:
    return _let(hashes, lambda a: F.zip_with(a, F.slice(a, step + 1, F.size(a)), lambda x, y: F.xxhash64(x, y)))


def covered_words(windows: Column, width: int = 8) -> Column:
    """Number of words inside windows whose hash occurs twice or more.

    Windows are sorted by hash; those like a neighbour are marked; marked places in
    order cover min(width, distance to the next) words each."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(placed)
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.transform(F.slice(placed, 1, n - 1), lambda s: s["h"]))
    after = F.concat(F.transform(F.slice(placed, 2, n), lambda s: s["h"]), F.array(F.lit(None).cast("bigint")))
    around = F.arrays_zip(placed.alias("s"), before.alias("b"), after.alias("a"))
    marked = F.filter(around, lambda t: F.coalesce(t["s"]["h"] == t["b"], F.lit(False)) | F.coalesce(t["s"]["h"] == t["a"], F.lit(False)))
    places = F.array_sort(F.transform(marked, lambda t: t["s"]["i"]))
    total = F.aggregate(
        places,
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-(1 << 30)).alias("end")),
        lambda acc, p: F.struct((acc["sum"] + p + width - F.greatest(p, acc["end"])).alias("sum"), (p + width).alias("end")),
        lambda acc: acc["sum"],
    )
    return total


def _rest(joined: Column) -> Column:
    """What is left of a text's words without lower-case letters."""
    return F.regexp_replace(joined, "\\p{Ll}+", "")


def _classes(rest: str) -> list[Column]:
    return [F.regexp_count(rest, F.lit(p)).cast("bigint").alias(f"c_{k}") for k, p in CLASSES.items()]


def measures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, lang, wh (word hashes), the base counts, and how many word characters
    each class and ``c_lower`` have.  Arrays are dropped as soon as they have been used:
    operators with lambdas copy rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit(ALL)).alias("lang"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda s: F.rlike(s, F.lit("[^\\x20\\x09-\\x0D]")))
    own = own.select("doc_id", "lang", words_of(F.col("text")).alias("words"), _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))
    own = own.select("doc_id", "lang", "n_dup_lines", F.size("words").cast("bigint").alias("n_words"), F.array_join("words", "").alias("joined"), F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    windows = window_hashes(F.col("wh"), limits.window, F.col("n_words"))
    own = own.select("doc_id", "lang", "n_dup_lines", "n_words", "wh", F.length("joined").cast("bigint").alias("word_chars"), _rest(F.col("joined")).alias("rest"), windows.alias("windows"))
    repeat = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("bigint")).otherwise(covered_words(F.col("windows"), limits.window))
    return own.select(
        "doc_id", "lang", "n_dup_lines", "n_words", "wh", "word_chars", repeat.alias("n_repeat_words"),
        F.regexp_count("rest", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        *_classes("rest"), (F.col("word_chars") - F.length("rest")).alias("c_lower"),
    )


def _by_lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(ALL)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _class_sums(own: DataFrame) -> DataFrame:
    """lang, all (word characters) and how many of them each class has."""
    joined = F.array_join(words_of(F.col("text")), "")
    classes = own.select("lang", joined.alias("j")).select("lang", F.length("j").alias("all"), _rest(F.col("j")).alias("rest")).select("lang", "all", *_classes("rest"), (F.col("all") - F.length("rest")).alias("c_lower"))
    return classes.groupBy("lang").agg(F.sum("all").alias("all"), *[F.sum(k).alias(k) for k in NAMES])


def _top(counts: DataFrame, n_common: int) -> DataFrame:
    """lang, w, n of each language's most common words, by partial top lists: hash parts
    first, then their winners."""
    part = Window.partitionBy("lang", "p").orderBy(F.desc("n"), "w")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    top = counts.withColumn("p", F.pmod(F.hash("w"), F.lit(64))).withColumn("r", F.row_number().over(part)).where(F.col("r") <= n_common)
    return top.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n_common).select("lang", "w", "n")


def _references(docs: DataFrame, limits: Limits) -> tuple[dict, dict, DataFrame | None]:
    """``references``, and a table (lang, q_chars, q_hashes, q_words) of the languages
    beyond ``max_languages``, None where there are none."""
    own = _by_lang(docs)
    counts = own.select("lang", F.explode(F.split("text", SPACE)).alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    counts = persist(counts, "quality-words")
    large = counts.where(F.col("lang") != ALL).groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= limits.min_reference_words)
    first = [r["lang"] for r in large.orderBy(F.desc("total"), "lang").limit(limits.max_languages + 1).collect()]
    langs, more = first[: limits.max_languages], len(first) > limits.max_languages
    held = F.col("lang").isin(langs) if langs else F.lit(False)
    chars = {r["lang"]: [r["all"], *(r[k] for k in NAMES)] for r in _class_sums(own.withColumn("lang", F.when(held, F.col("lang")).otherwise(F.lit(ALL)))).collect()}
    chars[ALL] = [sum(c[i] for c in chars.values()) for i in range(2 + len(CLASSES))] if chars else [0] * (2 + len(CLASSES))
    hashed = ("lang", F.xxhash64("w").alias("h"), "n")
    whole = counts.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(limits.n_common)
    rows = [*_top(counts.where(held), limits.n_common).select(*hashed).collect(), *whole.withColumn("lang", F.lit(ALL)).select(*hashed).collect()]
    words: dict = {k: [] for k in [*langs, ALL]}
    for r in sorted(rows, key=lambda r: (r["lang"], -r["n"], r["h"])):
        words[r["lang"]].append((r["h"], r["n"]))
    shares = {}
    for k, (total, *rest) in chars.items():
        rest = [*rest, total - sum(rest)]
        shares[k] = [c / total if total else 0.0 for c in rest]
    words = {k: [(h, n / max(1, sum(x[1] for x in v))) for h, n in v] for k, v in words.items()}
    return shares, words, _further(own, counts, large.where(~held), limits) if more else None


def _further(own: DataFrame, counts: DataFrame, large: DataFrame, limits: Limits) -> DataFrame:
    large = large.select("lang")
    of_words = _top(counts.join(large, "lang", "left_semi"), limits.n_common).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.xxhash64("w").alias("h")))).alias("top"), F.sum("n").alias("total"))
    of_words = of_words.select("lang", F.transform("top", lambda t: t["h"]).alias("q_hashes"), F.transform("top", lambda t: -t["n"] / F.col("total")).alias("q_words"))
    of_chars = _class_sums(own.join(large, "lang", "left_semi"))
    left = F.col("all")
    for k in NAMES:
        left = left - F.col(k)
    of_chars = of_chars.select("lang", F.array(*[c / F.col("all") for c in (*map(F.col, NAMES), left)]).alias("q_chars"))
    zeros = F.array_repeat(F.lit(0.0), F.lit(limits.n_common) - F.size("q_words"))
    return persist(of_words.join(of_chars, "lang").select("lang", "q_chars", "q_hashes", F.concat("q_words", zeros).alias("q_words")), "quality-languages")


def references(docs: DataFrame, limits: Limits = Limits()) -> tuple[dict, dict]:
    """Language references, counted over all documents: {lang: {class: share}} and
    {lang: [(word hash, share)]} of the most common words; "*" is all documents.

    Words are counted by (language, word) with partial sums; what reaches the driver
    is ``n_common`` words for at most ``max_languages`` languages (those with most
    words, each with at least ``min_reference_words``) and for all documents, and one
    row of class counts each."""
    return _references(docs, limits)[:2]


def _js(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares: the root of the divergence in bits."""

    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / F.when(m > 0, m).otherwise(1.0))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) / 2, F.lit(0.0)))


def _marks(hashes: Column, wanted: list[int]) -> Column:
    """A character (from "0" on) for each wanted hash, by its place in the list; a class
    is then counted by the length that its character leaves."""
    places = F.array(*[F.lit(h) for h in wanted])
    found = F.filter(hashes, lambda h: h.isin(wanted))
    return F.array_join(F.transform(found, lambda h: F.char(F.array_position(places, h) + 47)), "")


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, char_js, word_js.

    Null texts count as empty and fail for their length; a null language means the
    reference of all; a histogram too small to judge has distance null and does not
    fail; repeated rows are judged each; an empty table gives no rows; extra columns
    are ignored; a very long text is one row's array of words.
    """
    chars, words, more = _references(docs, limits)
    known = [k for k in words if k != ALL]
    if more is None:
        return _judged(_held(measures(docs, limits), chars, words, limits), limits)
    held = F.coalesce(F.col("lang").cast("string"), F.lit(ALL)).isin([*known, ALL])
    further = measures(docs.where(~held), limits).join(more, "lang", "left")
    parts = [_held(d, chars, words, limits) for d in (measures(docs.where(held), limits), further)]
    return _judged(parts[0].unionByName(parts[1]), limits)


def _held(of: DataFrame, chars: dict, words: dict, limits: Limits) -> DataFrame:
    """``measures`` with marks, judged (whether the reference has words), q_words and
    q_chars, by the references that the driver holds or by those of ``more`` joined to it."""
    known = [k for k in words if k != ALL]
    of = of.withColumn("ref", F.when(F.col("lang").isin(known), F.col("lang")).otherwise(F.lit(ALL)) if known else F.lit(ALL))
    k = limits.n_common

    def by_ref(values: dict, kind: str) -> Column:
        out = F.array(*[F.lit(v) for v in values[ALL]]).cast(kind)
        for name in known:
            out = F.when(F.col("ref") == name, F.array(*[F.lit(v) for v in values[name]]).cast(kind)).otherwise(out)
        return out

    share = by_ref({n: [s for _, s in v] + [0.0] * (k - len(v)) for n, v in words.items()}, "array<double>")
    marks = F.lit(None).cast("string")
    for name in [*known, ALL]:
        own = [h for h, _ in words[name]]
        if own:
            marks = F.when(F.col("ref") == name, _marks(F.col("wh"), own)).otherwise(marks)
    q_chars = by_ref(chars, "array<double>")
    if "q_hashes" in of.columns:
        own = F.transform(F.filter("wh", lambda h: F.array_contains("q_hashes", h)), lambda h: F.char(F.array_position("q_hashes", h) + 47))
        marks = F.when(F.col("q_hashes").isNotNull(), F.array_join(own, "")).otherwise(marks)
        share, q_chars = F.coalesce("q_words", share), F.coalesce("q_chars", q_chars)
    of = of.withColumns({"marks": marks, "q_words": share, "q_chars": q_chars}).drop("wh")
    return of.withColumns({"judged": F.col("marks").isNotNull(), "marks": F.coalesce("marks", F.lit(""))}).drop("ref", "q_hashes")


def _judged(of: DataFrame, limits: Limits) -> DataFrame:
    k = limits.n_common
    of = of.withColumn("n_common", F.length("marks"))
    safe = F.greatest(F.col("n_common"), F.lit(1)).cast("double")
    p_words = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.col("n_common") - F.length(F.replace("marks", F.char(i + 48), F.lit("")))) / safe)
    word_js = _js(p_words, F.col("q_words"))
    letters = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    counted = [F.col(f"c_{c}") for c in (*CLASSES, "lower")]
    rest = F.col("word_chars")
    for c in counted:
        rest = rest - c
    char_js = _js(F.array(*[c / letters for c in [*counted, rest]]), F.col("q_chars"))
    of = of.withColumn("char_js", F.when(F.col("word_chars") >= limits.min_chars, char_js))
    of = of.withColumn("word_js", F.when((F.col("n_words") >= limits.min_judged_words) & F.col("judged"), F.when(F.col("n_common") == 0, F.lit(1.0)).otherwise(word_js)))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_pct * F.col("n_words"))
    far = F.coalesce(F.col("char_js") > limits.max_char_js, F.lit(False)) | F.coalesce(F.col("word_js") > limits.max_word_js, F.lit(False))
    return of.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "char_js", "word_js")
