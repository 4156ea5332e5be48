"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations.

A tree of domains, languages and sources has a weight at each node.  A node's token
budget is divided among its children by weight; a child that cannot use its part
(its capacity is its tokens times the number of epochs) leaves the shortage to its
siblings, and only what a whole family cannot use reaches the parent's siblings.
A leaf's budget is then filled with whole epochs and a token prefix of the next one,
in an order that the seed and the epoch determine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import persist

#: A leaf's order is cut into this many hash ranges (a power of two), so that no window
#: holds more than one of them.
RANGES = 1024
_KEY_BITS = 32


@dataclass(frozen=True)
class MixPlan:
    """Weights are whole numbers; a name without one has ``default``.  ``budget`` is the
    share of all tokens (of one epoch) to select, in thousandths."""

    domain_weights: dict[str, int] = field(default_factory=dict)
    lang_weights: dict[str, int] = field(default_factory=dict)
    source_weights: dict[str, int] = field(default_factory=dict)
    default: int = 1
    budget_per_mille: int = 800
    max_epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The stand-in domain of a source: its number's remainder by 3 (no number: 0)."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.concat(F.lit("dom"), F.when(number == "", F.lit(0)).otherwise(F.try_to_number(number, F.lit("999999999")).cast("bigint") % 3).cast("string"))


def n_tokens_of(text: Column) -> Column:
    """Words, by ASCII white space; a text without words counts one token, so that
    every document has a place in its leaf's order."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(1)).cast("bigint")


def _weight(column: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, v in weights.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out.cast("bigint")


def share_out(nodes: DataFrame, parent: list[str], name: str, weight: Column, total: Column) -> DataFrame:
    """Adds ``alloc`` to siblings (rows with equal ``parent``): capped proportional shares.

    Sorted by capacity per weight, the nodes that are full form a prefix: a node is
    full if its capacity is at most its share of what the nodes before it, all full,
    leave.  The others share the rest by weight.  Division rounds down, so a parent's
    budget is never exceeded.  Needs the columns cap and the parent's budget ``total``."""
    n = nodes.withColumn("w", F.greatest(weight, F.lit(0))).withColumn("total", F.least(total, F.sum("cap").over(Window.partitionBy(*parent))))
    # a node of weight 0 comes last and gets what is left when all others are full
    ratio = F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy("ratio", name)
    n = n.withColumn("ratio", ratio)
    ahead, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    n = n.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(ahead), F.lit(0))).withColumn("rest_w", F.sum("w").over(behind))
    product = F.col("left").cast("decimal(38,0)") * F.col("w")
    full = (F.col("left") > 0) & F.when(F.col("rest_w") > 0, F.col("cap").cast("decimal(38,0)") * F.col("rest_w") <= product).otherwise(F.col("cap") <= F.col("left"))
    n = n.withColumn("full", full)
    n = n.withColumn("not_full", F.sum(F.when(F.col("full"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = Window.partitionBy(*parent)
    n = n.withColumn("at_left", F.max(F.when(F.col("not_full") == 1, F.col("left"))).over(first)).withColumn("at_w", F.max(F.when(F.col("not_full") == 1, F.col("rest_w"))).over(first))
    part = F.when(F.col("at_w") > 0, F.expr("cast(cast(at_left as decimal(38,0)) * w div at_w as bigint)")).otherwise(F.when(F.col("not_full") == 1, F.col("left")).otherwise(F.lit(0)))
    alloc = F.when(F.col("not_full") == 0, F.col("cap")).otherwise(F.least(F.greatest(part, F.lit(0)), F.col("cap")))
    return n.withColumn("alloc", alloc.cast("bigint")).drop("w", "total", "ratio", "left", "rest_w", "full", "not_full", "at_left", "at_w")


def budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """domain, lang, source, tokens, alloc from leaves (domain, lang, source, tokens)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * plan.max_epochs)
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("t"))
    want = F.expr(f"cast(cast(sum(t) over () as decimal(38,0)) * {plan.budget_per_mille} div 1000 as bigint)")
    top = share_out(top.withColumn("want", want).withColumn("root", F.lit(0)), ["root"], "domain", _weight("domain", plan.domain_weights, plan.default), F.col("want"))
    mid = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(top.select("domain", F.col("alloc").alias("want")), "domain")
    mid = share_out(mid, ["domain"], "lang", _weight("lang", plan.lang_weights, plan.default), F.col("want"))
    low = leaves.join(mid.select("domain", "lang", F.col("alloc").alias("want")), ["domain", "lang"])
    return share_out(low, ["domain", "lang"], "source", _weight("source", plan.source_weights, plan.default), F.col("want")).select("domain", "lang", "source", "tokens", "alloc")


def order_key(doc_id: Column, seed: int, epoch: Column) -> Column:
    """32-bit place of a document in an epoch, from an MD5 of seed, epoch and id."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


_LEAF = ["mix_domain", "mix_lang", "mix_source"]


def _keyed(docs: DataFrame, tokens: Column) -> DataFrame:
    source = F.coalesce(F.col("source").cast("string"), F.lit("null"))
    return docs.select(
        "*", domain_of(source).alias("mix_domain"), F.coalesce(F.col("lang").cast("string"), F.lit("null")).alias("mix_lang"), source.alias("mix_source"), tokens.alias("mix_tokens")
    )


def _light(keyed: DataFrame) -> DataFrame:
    """Per document: leaf, tokens, id and text hash, without the text."""
    return keyed.select(*_LEAF, "mix_tokens", F.col("doc_id").cast("bigint").alias("mix_id"), F.xxhash64(F.col("text").cast("string")).alias("mix_tie"))


def _places(light: DataFrame, plan: MixPlan) -> DataFrame:
    """Per document and epoch: leaf, tokens, and the order key, id and text hash that
    order them."""
    epochs = F.explode(F.array(*[F.lit(e) for e in range(plan.max_epochs)])).alias("mix_epoch")
    light = light.select("*", epochs)
    light = light.withColumn("mix_key", order_key(F.col("mix_id"), plan.seed, F.col("mix_epoch")))
    return light.withColumn("mix_range", F.shiftright("mix_key", _KEY_BITS - RANGES.bit_length() + 1)).withColumn("mix_id", F.coalesce("mix_id", F.lit(-(1 << 63))))


def cuts(docs: DataFrame, plan: MixPlan, tokens: Column) -> DataFrame:
    """For each leaf and epoch that gets anything, the last place selected: mix_last
    (key, id, tie), null where the whole epoch is.

    Texts are read once for it: their token counts are written without them.  Sums of the
    leaves' hash ranges place every range; only the range where a budget ends is ordered
    row by row."""
    places = _places(persist(_light(_keyed(docs, tokens)), "mix-tokens"), plan)
    group = [*_LEAF, "mix_epoch"]
    ranges = persist(places.groupBy(*group, "mix_range").agg(F.sum("mix_tokens").alias("s")), "mix-ranges")
    named = [F.col(c).alias(c[4:]) for c in _LEAF]
    leaves = ranges.where("mix_epoch = 0").groupBy(*named).agg(F.sum("s").alias("tokens"))
    planned = budgets(leaves, plan).select(*[F.col(c[4:]).alias(c) for c in _LEAF], "tokens", "alloc", F.explode(F.sequence(F.lit(0), F.lit(plan.max_epochs - 1))).alias("mix_epoch"))
    cut = F.greatest(F.least(F.col("alloc") - F.col("mix_epoch") * F.col("tokens"), F.col("tokens")), F.lit(0))
    planned = persist(planned.withColumn("cut", cut).where("cut > 0").select(*group, "tokens", "cut"), "mix-plan")
    before = F.coalesce(F.sum("s").over(Window.partitionBy(*group).orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ranges.join(planned.where("cut < tokens"), group).withColumn("base", before).where("base < cut and cut <= base + s").select(*group, "mix_range", "base", "cut")
    inside = places.join(persist(ends, "mix-ends"), [*group, "mix_range"])
    order = Window.partitionBy(*group).orderBy("mix_key", "mix_id", "mix_tie").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.col("base") + F.sum("mix_tokens").over(order) - F.sum("mix_tokens").over(Window.partitionBy(*group, "mix_key", "mix_id", "mix_tie"))
    last = inside.withColumn("ahead", ahead).where("ahead < cut").groupBy(*group).agg(F.max(F.struct("mix_key", "mix_id", "mix_tie")).alias("mix_last"))
    return persist(planned.select(*group).join(last, group, "left"), "mix-cuts")


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), tokens: Column | None = None) -> DataFrame:
    """A row for each selection of a document: all its columns, and mix_domain,
    mix_tokens and mix_epoch (0 first).

    A document is selected in an epoch if the tokens of its leaf before it, in that
    epoch's order, are below the epoch's part of the leaf's budget: a leaf exceeds its
    budget by less than one document.  Epochs before the last are whole.  Null
    languages and sources are leaves of their own ("null"); rows equal in doc_id and
    text are selected together; extra columns pass through, but those whose names
    begin with ``mix_`` are replaced; an empty table stays empty.

    Texts, however long, are not shuffled: documents meet a table of one row a leaf and
    epoch, which Spark broadcasts only while its files are below its threshold.
    """
    tokens = n_tokens_of(F.col("text").cast("string")) if tokens is None else tokens
    own = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    ends = cuts(own, plan, tokens)
    joined = _keyed(own, tokens).join(ends, _LEAF)
    place = F.struct(
        order_key(F.col("doc_id").cast("bigint"), plan.seed, F.col("mix_epoch")).alias("mix_key"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("mix_id"),
        F.xxhash64(F.col("text").cast("string")).alias("mix_tie"),
    )
    kept = joined.where(F.col("mix_last").isNull() | (place <= F.col("mix_last")))
    return kept.select(*[F.col(f"`{c}`") for c in own.columns], "mix_domain", "mix_tokens", "mix_epoch")
