"""Language identification in two steps: the family, then the language within it.

Features are counts of hashed 1- to 3-grams of lower-cased letters (all else is a
space), log-scaled and brought to unit length.  Families are learned: languages'
mean vectors are merged by average cosine similarity until about sqrt(#languages)
groups are left.  One linear SVM a family tells it from the rest; within a family
one linear SVM for each pair of languages votes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import arrow_schema, batch, docs_view, struct_of, text_slices

DIM = 4096
#: The classifier is fitted on so many different texts a language, in all (but for many
#: languages), and at least.
SAMPLE_PER_LANG, SAMPLE_TOTAL, LEAST_PER_LANG = 400, 6000, 8
_LETTER: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def features(text: str | None, dim: int = DIM) -> np.ndarray | None:
    """Unit vector of a whole text, or None if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letter_table()[codes]
    if not letter.any():
        return None
    c = np.where(letter, codes, 32).astype(np.uint32)
    keep = np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))  # runs of spaces count once
    c = np.concatenate(([np.uint32(32)], c[keep], [np.uint32(32)]))
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) + c[1:] * np.uint32(0x27D4EB2F)
    three = (two[:-1] ^ np.uint32(0x165667B1)) * np.uint32(0x9E3779B1) + c[2:] * np.uint32(0x85EBCA6B)
    shift = np.uint32(32 - dim.bit_length() + 1)
    counts = sum(np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, minlength=dim) for h in (one, two, three))
    x = np.log1p(counts).astype(np.float32)
    return x / np.linalg.norm(x)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 40, seed: int = 5) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, by dual
    coordinate descent; classes weigh alike.  y holds +1 and -1."""
    x = np.hstack((x, np.ones((len(x), 1), dtype=np.float32)))
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    diag = 0.5 / (cost * share)
    w, alpha = np.zeros(x.shape[1], dtype=np.float32), np.zeros(len(y))
    norm = (x * x).sum(axis=1) + diag
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)):
            grad = y[i] * float(x[i] @ w) - 1 + diag[i] * alpha[i]
            step = max(alpha[i] - grad / norm[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * x[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


@dataclass
class LanguageModel:
    families: list[list[str]] = field(default_factory=list)
    family_w: np.ndarray | None = None  # a row a family
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and score: the family's share among squashed margins, times the
        mean squashed margin of the language's pairs."""
        if not self.families:
            return "und", 0.0
        x = np.append(x, np.float32(1))
        score, best = 1.0, 0
        if len(self.families) > 1:
            p = 1 / (1 + np.exp(-4.0 * (self.family_w @ x)))
            best = int(p.argmax())
            score = float(p[best] / p.sum())
        langs = self.families[best]
        if len(langs) == 1:
            return langs[0], score
        votes, sure = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for (a, b), w in self.pairs.items():
            if a in votes and b in votes:
                p = float(1 / (1 + np.exp(-4.0 * float(w @ x))))
                votes[a if p >= 0.5 else b] += 1
                sure[a] += p
                sure[b] += 1 - p
        lang = max(langs, key=lambda k: (votes[k], sure[k]))
        return lang, min(1.0, max(0.0, score * sure[lang] / (len(langs) - 1)))


def learn_families(means: np.ndarray, n_families: int) -> list[list[int]]:
    """Average-linkage merging of the most similar groups."""
    groups = [[i] for i in range(len(means))]
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    like = unit @ unit.T
    while len(groups) > n_families:
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: like[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return groups


def fit_arrays(x: np.ndarray, langs: list[str]) -> LanguageModel:
    names = sorted(set(langs))
    if not names:
        return LanguageModel()
    number = {k: i for i, k in enumerate(names)}
    y = np.array([number[k] for k in langs])
    means = np.stack([x[y == i].mean(axis=0) for i in range(len(names))])
    groups = learn_families(means - means.mean(axis=0), max(1, round(len(names) ** 0.5)))
    family = np.zeros(len(names), dtype=int)
    for g, members in enumerate(groups):
        family[members] = g
    model = LanguageModel([[names[i] for i in sorted(g)] for g in groups])
    if len(groups) > 1:
        model.family_w = np.stack([train_svm(x, np.where(family[y] == g, 1.0, -1.0)) for g in range(len(groups))])
    for g in groups:
        for a, b in combinations(sorted(g), 2):
            rows = (y == a) | (y == b)
            model.pairs[names[a], names[b]] = train_svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))
    return model


def fit(train: DataFrame, per_lang: int = SAMPLE_PER_LANG, total: int = SAMPLE_TOTAL) -> LanguageModel:
    """Learns from ``text`` and non-null ``lang``.

    The classifier is fitted on the texts of each language whose hashes are least:
    ``per_lang`` of them, or as many as ``total`` leaves a language, and never fewer than
    ``LEAST_PER_LANG``.  Texts without letters are left out, copies of a text count once,
    and every language that has a text with a letter is learned, however rare it is.
    Languages are counted over all rows; what reaches the driver is a row a language, as
    in the model itself, and the sample's vectors."""
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    rows = train.select(text.alias("text"), lang.alias("lang")).where("lang is not null").where(F.rlike("text", F.lit("\\p{L}")))
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(11)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return LanguageModel()
    want = max(LEAST_PER_LANG, min(per_lang, total // len(counts)))
    spark = train.sparkSession
    # rows that can be among the least: eight times as many texts as wanted fall below the bound
    bounds = spark.createDataFrame([(k, int(min(1.0, 8 * want / n) * (1 << 62))) for k, n in counts.items()], "lang string, bound bigint")
    low = rows.join(F.broadcast(bounds), "lang").where(F.shiftrightunsigned("h", 2) <= F.col("bound"))
    least = low.groupBy("lang", "h").count().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 2), "h")))
    chosen = least.where(F.col("r") <= want).select("lang", "h").collect()
    # at most ``want`` texts a language, which bounds the broadcast; a text comes once a task and is then met with its copies
    picked = rows.join(F.broadcast(spark.createDataFrame([(r["lang"], r["h"]) for r in chosen], "lang string, h bigint")), ["lang", "h"]).select("lang", "h", "text")
    out = struct_of("lang string, h bigint, x binary")
    schema = arrow_schema(out)

    def run(batches):
        done = set()
        for b, texts in text_slices(batches):
            fresh = {(k, h): t for k, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts) if (k, h) not in done}
            done |= fresh.keys()
            found = [(k, h, f.astype(np.float16).tobytes()) for (k, h), t in fresh.items() if (f := features(t)) is not None]
            yield batch(schema, [list(c) for c in zip(*found)] if found else [[], [], []])

    vectors = picked.mapInArrow(run, out).groupBy("lang", "h").agg(F.min("x").alias("x"))
    kept = sorted((r["lang"], r["h"], bytes(r["x"])) for r in vectors.collect())
    if not kept:
        return LanguageModel()
    return fit_arrays(np.stack([np.frombuffer(f, dtype=np.float16) for _, _, f in kept]).astype(np.float32), [k for k, _, _ in kept])


_PRED = "lang_pred string, score double"


def predict(docs: DataFrame, model: LanguageModel, *keep: str) -> DataFrame:
    """The columns ``keep`` with lang_pred and score (0 to 1) of each whole text.

    ``und`` with score 0 for a null text, one without letters, or a model without
    languages.  Repeated rows give repeated rows; an empty table gives none.  Texts that
    are kept go to Python once, and come back in small batches."""
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))  # the results replace them
    fields = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields
    out = T.StructType(fields + struct_of(_PRED).fields)
    own = [c == "text" and isinstance(f.dataType, T.StringType) for c, f in zip(keep, fields)]
    columns = [F.col(f"`{c}`").alias("text" if read else f"c{i}") for i, (c, read) in enumerate(zip(keep, own))]
    frame = docs.select(*columns, *([] if any(own) else [F.col("text").cast("string").alias("text")]))
    schema = arrow_schema(out)

    def run(batches):
        for rows, texts in text_slices(batches, 2 << 20):
            found = [("und", 0.0) if (x := features(t)) is None else model.predict(x) for t in texts]
            yield batch(schema, [*[rows.column(i) for i in range(len(keep))], [f[0] for f in found], [f[1] for f in found]])

    return frame.mapInArrow(run, out)


def held_out(doc_id: Column | str, mod: int, rest: int) -> Column:
    """Whether crc32 of the id's text leaves ``rest``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == rest, F.lit(False))
