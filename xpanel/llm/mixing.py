"""Temperature mixing of sources, in DataFrame functions only.

A source's share q of all tokens becomes the weight q^a / sum(q^a). The exponent a in [0, 1] is found by bisection (in
sections of SECTIONS per Spark job, over the table of source totals): the largest a whose weights reach the target
entropy, or the smallest a at which no source is repeated more than max_repetition times as often as the least repeated.
Weights become token budgets, and a budget becomes whole epochs and a part of one: each epoch of a source is a
permutation of its N_BLOCKS blocks, and the partial epoch takes blocks in that order while they fit the budget.

The default budget is the smallest that visits every document once, so nothing is lost. Tokens are estimated as a
quarter of the UTF-8 bytes, rounded up; pass a column for other counts. A null source is a source of its own. Documents
without tokens, and sources that have no tokens at all, are taken once per whole epoch (once at least under the default
budget). Repeated rows share a block and stay together; null doc_ids share one block. mix_sources gives the columns of docs as one
struct `row`, so they may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xpanel.llm.common import materialise, nested

N_BLOCKS, SECTIONS, ROUNDS = 4096, 32, 11
BROADCAST_SOURCES = 50_000  #: up to so many sources (a few MB) the plan is broadcast, beyond it is joined by shuffle


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def hash48(*parts: Column) -> Column:
    """The first 48 bits of an MD5 over the parts (null: empty)."""
    joined = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 12), 16, 10).cast("long")


def _bisect(totals: DataFrame, holds, lo: float = 0.0, hi: float = 1.0) -> float:
    """The point between lo and hi where holds(a) over the rows of totals turns from false to true; holds is monotone."""
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / SECTIONS for i in range(1, SECTIONS)]
        tried = totals.withColumn("a", F.explode(F.array(*map(F.lit, grid)))).groupBy("a").agg(holds(F.col("a")).alias("holds")).collect()
        lo, hi = max([lo, *(r["a"] for r in tried if not r["holds"])]), min([hi, *(r["a"] for r in tried if r["holds"])])
        if hi - lo < 1e-15:
            break
    return hi


def exponent(totals: DataFrame, target_entropy: float | None, max_repetition: float | None) -> float:
    """totals has a share q > 0 per source. With an entropy target (a part of the highest entropy) that decides."""
    if target_entropy is not None:
        z = lambda a: F.sum(F.pow("q", a))
        entropy = lambda a: F.log(z(a)) - F.sum(a * F.pow("q", a) * F.log("q")) / z(a)
        return _bisect(totals, lambda a: entropy(a) < target_entropy * F.log(F.count("*")))
    if max_repetition is not None:
        repetition = lambda a: F.max(F.pow("q", a - 1)) / F.min(F.pow("q", a - 1))
        return _bisect(totals, lambda a: repetition(a) <= max_repetition)
    return 1.0


def mix_sources(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = 1.5, budget_tokens: int | None = None, tokens: Column | None = None, key: str = "doc_id", source: str = "source") -> DataFrame:
    """row (the columns of docs), a row per draw, with n_tokens, source_weight, epoch, block and block_order (its place in that epoch's
    permutation)."""
    tokens = estimated_tokens(F.col("text")) if tokens is None else tokens
    block = F.pmod(hash48(F.lit("block"), F.col(key)), F.lit(N_BLOCKS)).cast("int")
    rows = docs.select(nested(docs).alias("row"), F.col(source).alias("source"), tokens.alias("n_tokens"), block.alias("block"))
    by_block = materialise(rows.groupBy(F.col("source").alias("_source"), "block").agg(F.sum("n_tokens").alias("block_tokens")))
    totals = materialise(by_block.groupBy("_source").agg(F.sum("block_tokens").alias("total")))
    summary = totals.agg(F.sum("total").alias("all"), F.max("total").alias("most"), F.count("*").alias("n")).first()
    every, most = summary["all"] or 0, summary["most"] or 0
    shares = totals.withColumn("q", F.col("total") / F.lit(max(every, 1)))
    a = exponent(shares.filter("q > 0"), target_entropy, max_repetition) if every else 1.0
    # epochs of a source: budget * weight / total = scale * q^(a - 1)
    z = shares.filter("q > 0").agg(F.sum(F.pow("q", F.lit(a)))).first()[0] or 1.0
    scale = (most / every) ** (1 - a) if budget_tokens is None and every else (budget_tokens or 0) / max(every, 1) / z
    epochs = F.when(F.col("q") > 0, F.lit(scale) * F.pow("q", F.lit(a - 1))).otherwise(1.0)
    plan = shares.select("_source", "total", epochs.alias("epochs"), F.when(F.col("q") > 0, F.pow("q", F.lit(a)) / F.lit(z)).otherwise(0.0).alias("source_weight"))
    plan = plan.withColumn("whole", F.floor(F.col("epochs") + 1e-9).cast("int")).withColumn("part", F.greatest(F.col("epochs") - F.col("whole"), F.lit(0.0)) * F.col("total"))
    order = lambda epoch, s: hash48(F.lit("order"), s, epoch, F.col("block"))
    # the last block that fits the partial epoch; a source has N_BLOCKS blocks at most
    placed = by_block.join(plan, by_block["_source"].eqNullSafe(plan["_source"])).select(plan["_source"], "part", "block_tokens", "block", order(F.col("whole"), plan["_source"]).alias("at"))
    run = F.sum("block_tokens").over(Window.partitionBy("_source").orderBy("at", "block"))
    cut = placed.withColumn("run", run).filter("run <= part").groupBy("_source").agg(F.max("at").alias("cut"))
    chosen = plan.join(cut.withColumnRenamed("_source", "_cut_source"), F.col("_source").eqNullSafe(F.col("_cut_source")), "left").select("_source", "whole", "source_weight", F.coalesce("cut", F.lit(-1)).alias("cut"))
    chosen = F.broadcast(chosen) if summary["n"] <= BROADCAST_SOURCES else chosen
    mixed = rows.join(chosen, rows["source"].eqNullSafe(chosen["_source"])).withColumn("_last", order(F.col("whole"), rows["source"]) <= F.col("cut"))
    upto = F.col("whole") - F.when(F.col("_last"), 0).otherwise(1)
    mixed = mixed.filter(upto >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), upto)))
    return mixed.select("row", "n_tokens", "source_weight", "epoch", "block", order(F.col("epoch"), F.col("source")).alias("block_order"))


def mix_report(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("row.doc_id", "row.source", "n_tokens", F.round("source_weight", 9).alias("source_weight"), "epoch", "block", "block_order")


def oracle(max_repetition: float = 1.5) -> str:
    """mix_report in SQL; under a repetition limit the exponent has a closed form."""
    assert math.isfinite(max_repetition)
    h = lambda s: f"('0x' || substr(md5({s}), 1, 12))::BIGINT"
    return f"""
    WITH rows AS (
      SELECT doc_id, source, CAST(ceil(strlen(coalesce(text, '')) / 4) AS BIGINT) AS n_tokens,
             CAST({h("'block/' || coalesce(CAST(doc_id AS VARCHAR), '')")} % {N_BLOCKS} AS INTEGER) AS block
      FROM documents),
    totals AS (SELECT source, sum(n_tokens)::DOUBLE AS total FROM rows GROUP BY source),
    expo AS (SELECT greatest(0.0, CASE WHEN max(total) = min(total) THEN 0.0 ELSE 1 - ln({max_repetition}) / ln(max(total) / min(total)) END) AS a,
                    sum(total) AS everything, max(total) AS most FROM totals WHERE total > 0),
    weights AS (
      SELECT source, total, CASE WHEN total > 0 THEN pow(most / total, 1 - a) ELSE 1.0 END AS epochs,
             CASE WHEN total > 0 THEN pow(total / everything, a) / sum(CASE WHEN total > 0 THEN pow(total / everything, a) ELSE 0 END) OVER () ELSE 0.0 END AS source_weight
      FROM totals, expo),
    plan AS (SELECT *, CAST(floor(epochs + 1e-9) AS INTEGER) AS whole FROM weights),
    blocks AS (
      SELECT r.source, p.whole, r.block, sum(n_tokens) AS block_tokens, any_value(greatest(p.epochs - p.whole, 0) * p.total) AS part,
             {h("'order/' || coalesce(r.source, '') || '/' || p.whole || '/' || r.block")} AS pos
      FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source GROUP BY r.source, p.whole, r.block),
    taken AS (
      SELECT source, block FROM (SELECT *, sum(block_tokens) OVER (PARTITION BY source ORDER BY pos, block) AS run FROM blocks) WHERE run <= part),
    draws AS (
      SELECT r.doc_id, r.source, r.n_tokens, p.source_weight, r.block, unnest(range(p.whole + CASE WHEN t.block IS NULL THEN 0 ELSE 1 END)) AS epoch
      FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
      LEFT JOIN taken t ON r.source IS NOT DISTINCT FROM t.source AND r.block = t.block)
    SELECT doc_id, source, n_tokens, round(source_weight, 9) AS source_weight, CAST(epoch AS INTEGER) AS epoch, block,
           {h("'order/' || coalesce(source, '') || '/' || epoch || '/' || block")} AS block_order
    FROM draws"""
