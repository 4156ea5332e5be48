"""The registered queries of this subpackage: ``opN_<name>`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, counting, fingerprints, langid, mixing, ngram_lm, packing, quality, simhash, sstable


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Target weights of the registered mix; a name that is not listed weighs 2.
MIX = mixing.MixPlan(
    domain_weights={"dom0": 3, "dom1": 2, "dom2": 1},
    lang_weights={"en": 4, "de": 3, "fr": 1},
    source_weights={"src1": 5, "src4": 1, "src7": 0},
    default=2,
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), tokenizer_path(), with_ids=False)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup.dedup_substrings(_docs(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "text", "removed_bytes", "removed_spans")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_docs(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_edits(_docs(spark, sf_dir), tokenizer_path())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", langid.held_out("doc_id", 4, 2))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, "doc_id", "held_out")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_docs(spark, sf_dir))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_docs(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text").withColumn("held_out", langid.held_out("doc_id", 5, 1))
    model = ngram_lm.train_model(docs.where(~F.col("held_out")))
    found = ngram_lm.score(docs, model, "doc_id", "held_out")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mixing.mix(_docs(spark, sf_dir), MIX)
    return kept.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sstable.write_shards(_docs(spark, sf_dir), tokenizer_path())
    return sstable.read_shards(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_packing, op2_substring_dedup, op3_fingerprints, op4_token_counts, op5_language_id, op6_simhash, op7_quality_rules, op8_lm_scoring, op9_mixing, op10_token_shards)
    return {f.__name__: f for f in named}


def _shares(table: str, parent: str, name: str, out: str) -> str:
    """SQL of capped shares by weight: ``table`` has parent, name, cap, want and w."""
    part, order = f"PARTITION BY {parent}", f"ORDER BY ratio, {name}"
    return f"""{out}1 AS (SELECT *, least(want, sum(cap) OVER ({part})) AS total, CASE WHEN w > 0 THEN CAST(cap AS DOUBLE) / w ELSE CAST('inf' AS DOUBLE) END AS ratio FROM {table}),
{out}2 AS (SELECT *, total - coalesce(sum(cap) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM {out}1),
{out}3 AS (SELECT *, sum(CASE WHEN rest > 0 AND CASE WHEN rest_w > 0 THEN cap * rest_w <= rest * w ELSE cap <= rest END THEN 0 ELSE 1 END) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after FROM {out}2),
{out}4 AS (SELECT *, max(CASE WHEN after = 1 THEN rest END) OVER ({part}) AS r, max(CASE WHEN after = 1 THEN rest_w END) OVER ({part}) AS n FROM {out}3),
{out} AS (SELECT *, CASE WHEN after = 0 THEN cap WHEN n > 0 THEN least(greatest(r * w // n, 0), cap) WHEN after = 1 THEN least(greatest(rest, 0), cap) ELSE 0 END AS alloc FROM {out}4)"""


def _weights(column: str, weights: dict[str, int], default: int) -> str:
    cases = "".join(f" WHEN {column} = '{k}' THEN {v}" for k, v in weights.items())
    return f"CAST(CASE{cases} ELSE {default} END AS BIGINT)" if cases else f"CAST({default} AS BIGINT)"


def _mix_sql(plan: mixing.MixPlan) -> str:
    """The plan by plain windows over whole leaves."""
    number = "regexp_extract(s, '([0-9]{1,9})$', 1)"
    dom, lang, src = (_weights(c, w, plan.default) for c, w in (("dom", plan.domain_weights), ("l", plan.lang_weights), ("s", plan.source_weights)))
    return f"""WITH d0 AS (SELECT *, coalesce(lang, 'null') AS l, coalesce(source, 'null') AS s, CAST(greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS tok FROM documents),
d AS (SELECT *, 'dom' || CASE WHEN {number} = '' THEN 0 ELSE CAST({number} AS BIGINT) % 3 END AS dom FROM d0),
leaf AS (SELECT dom, l, s, CAST(sum(tok) AS BIGINT) AS tokens, CAST(sum(tok) AS BIGINT) * {plan.max_epochs} AS cap FROM d GROUP BY dom, l, s),
t0 AS (SELECT 0 AS root, dom, sum(cap) AS cap, (SELECT sum(tokens) * {plan.budget_per_mille} // 1000 FROM leaf) AS want, {dom} AS w FROM leaf GROUP BY dom),
{_shares("t0", "root", "dom", "t")},
m0 AS (SELECT leaf.dom, l, sum(leaf.cap) AS cap, max(t.alloc) AS want, {lang} AS w FROM leaf JOIN t ON t.dom = leaf.dom GROUP BY leaf.dom, l),
{_shares("m0", "dom", "l", "m")},
b0 AS (SELECT leaf.*, m.alloc AS want, {src} AS w FROM leaf JOIN m ON m.dom = leaf.dom AND m.l = leaf.l),
{_shares("b0", "dom, l", "s", "b")},
p AS (SELECT d.*, e.range AS epoch, greatest(least(b.alloc - e.range * b.tokens, b.tokens), 0) AS cut, CAST('0x' || substr(md5('{plan.seed}|' || e.range || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS place
  FROM d JOIN b ON b.dom = d.dom AND b.l = d.l AND b.s = d.s CROSS JOIN range({plan.max_epochs}) e),
q AS (SELECT *, coalesce(sum(tok) OVER (PARTITION BY dom, l, s, epoch ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM p)
SELECT doc_id, dom AS domain, lang, source, tok AS n_tokens, CAST(epoch AS INT) AS epoch FROM q WHERE ahead < cut"""


def oracle_sql() -> dict[str, str]:
    """Mixing has an SQL form; the others need tokenizers, rolling hashes, XXH64, trained
    models or tries, and are held against brute force in the tests."""
    return {"op9_mixing": _mix_sql(MIX)}
