"""Which filter removes what, in every order of the filters.

A document fails a set of filters, its mask. In a given order it is removed at the first filter of its mask, so only the number of
documents of each part and mask matters, a bounded table. For a mask, a filter of it and a step, the orders that remove there are
those that begin with other filters outside the mask and then have this one: for each such beginning one interval of the
orders' lexicographic (Lehmer) ranks. The counts are added at the intervals' starts and taken off at their ends, and a prefix sum over
the ranks gives what every order removes at every step: no document is looked at once for each order.

Whether a text is a copy is decided over the whole table by its SHA-256: documents are first put together by text, mask and labels,
so a text that a third of all rows share is a few rows after the first step.

Null texts are empty texts, null parts the part "". A document without an id is no copy and has no labels, and nothing is a copy
of it; rows that repeat an id are documents of their own, none smaller than the other. A label counts for a document if any row
of its id holds it. An empty table has no parts and gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A separator of words, and the signs that filter D looks for.
BLANKS, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
LETTERS = "ABCDE"


def intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step from 1, first rank, rank after the last) of the orders of n filters in which a document with the mask goes at that step.

    A beginning of `step` filters fixes an interval of (n - step)! ranks, and each order has one beginning of that length.
    """
    out = []
    for step in range(1, n + 1):
        width = factorial(n - step)
        for i, beginning in enumerate(permutations(range(n), step)):  # in lexicographic order, as the ranks are
            passed, at = sum(1 << f for f in beginning[:-1]), 1 << beginning[-1]
            out += [(mask, step, i * width, (i + 1) * width) for mask in range(1 << n) if mask & at and not mask & passed]
    return out


def row_filters(text: Column) -> list[Column]:
    """Whether a text fails filters A to D: short, repetitive, shouting, with signs."""
    words = F.array_remove(F.split(text, BLANKS), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [F.size(words) < 100, 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), 100 * capitals.cast("long") > 10 * F.length(text), text.rlike(SIGNS)]


def mask_of(fails: list[Column]) -> Column:
    """Bit i is set where filter i fails."""
    mask = F.lit(0)
    for i, f in enumerate(fails):
        mask = mask + F.when(f, 1 << i).otherwise(0)
    return mask


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: how many documents of a part fail just that set of filters, and how many of them are labelled so."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), mask_of(row_filters(text)).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    # rows without an id meet no label: their hashes deal them out
    lone = F.col("doc_id").isNull()
    rows = rows.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_deal": F.when(lone, F.xxhash64("digest") % 1024 + 1025).otherwise(0)})
    marks = marks.filter("good OR toxic").select(F.col("doc_id").alias("_id"), F.lit(0).cast("long").alias("_deal"), "good", "toxic")
    rows = rows.join(marks, ["_id", "_deal"], "left").fillna(False, ["good", "toxic"])
    same = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"), F.sum("n").alias("n"), F.sum(F.when(lone, F.col("n")).otherwise(0)).alias("lone")
    )
    first = F.min("first").over(Window.partitionBy("digest"))  # a row per part and label
    same = same.withColumn("passed", F.col("lone") + F.when(F.col("first") == first, F.col("at_first")).otherwise(0))
    copy = 1 << (len(LETTERS) - 1)
    sides = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passed").alias("docs")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("passed")).alias("docs"))))
    out = same.select("part", "good", "toxic", sides.alias("s")).select("part", "s.*", "good", "toxic")
    marked = lambda c: F.sum(F.when(F.col(c), F.col("docs")).otherwise(0)).alias(c)
    return out.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), marked("good"), marked("toxic"))


def order_report(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """From failure_counts: a row per part, order of the filters and step, with what is kept, removed, redundant and lost."""
    spark, n = counts.sparkSession, len(letters)
    ranks, what = factorial(n), ("docs", "good", "toxic")
    table = F.broadcast(spark.createDataFrame(intervals(n), "mask int, step int, start int, stop int"))  # bounded by n alone
    ends = F.explode(F.array(F.struct(F.col("start").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("rank"), F.lit(-1).alias("sign"))))
    changes = counts.join(table, "mask").select("part", "step", ends.alias("e"), *what).select("part", "step", "e.rank", *[(F.col("e.sign") * F.col(c)).alias(c) for c in what])
    every = F.explode(F.expr(f"flatten(transform(sequence(1, {n}), s -> transform(sequence(0, {ranks - 1}), r -> struct(s AS step, r AS rank))))"))
    nothing = counts.select("part").distinct().select("part", every.alias("e")).select("part", "e.*", *[F.lit(0).cast("long").alias(c) for c in what])
    changes = changes.unionByName(nothing).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in what])
    so_far = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = changes.select("part", "step", "rank", *[F.sum(c).over(so_far).alias(c) for c in what]).filter(F.col("rank") < ranks)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    removed = removed.withColumn("filter_order", F.element_at(orders, F.col("rank") + 1)).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bit = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    totals = counts.groupBy("part").agg(
        F.sum("docs").alias("total"),
        F.map_from_arrays(F.array(*map(F.lit, letters)), F.array(*[F.sum(F.when(bit(i), F.col("docs")).otherwise(0)) for i in range(n)])).alias("fails"),
        F.map_from_arrays(F.array(*map(F.lit, letters)), F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("docs")).otherwise(0)) for i in range(n)])).alias("alone"),
    )
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return removed.join(totals, "part").select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("docs").over(steps)).alias("kept"), F.col("docs").alias("removed"), (F.col("fails")[F.col("letter")] - F.col("docs")).alias("redundant"),
        F.col("alone")[F.col("letter")].alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("docs").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return order_report(failure_counts(docs, labels))


def oracle() -> str:
    """audit_filters in SQL: every order is walked through."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(LETTERS))
    bits = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(LETTERS))
    mark = lambda c, v: f"coalesce(doc_id IN (SELECT doc_id FROM labels WHERE {c} = {v}), false)"
    return rf"""
    WITH w AS (
      SELECT *, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '') AS words,
             min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
    m AS (
      SELECT coalesce(lang, '') AS part, {mark("quality", 1)} AS good, {mark("toxic", 1)} AS toxic,
             (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '{SIGNS}')::INT
             + 16 * coalesce(doc_id > first, false)::INT AS mask
      FROM w),
    c AS (SELECT part, mask, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
    bits(letter, bit) AS (VALUES {bits}),
    steps AS (
      SELECT filter_order, step, letter, bit,
             coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS earlier
      FROM (VALUES {orders}) o(filter_order), range(1, {len(LETTERS) + 1}) r(step) JOIN bits ON letter = substr(filter_order, step, 1)),
    r AS (
      SELECT part, filter_order, step, letter, sum(docs) FILTER (mask & earlier = 0 AND mask & bit = 0) AS kept, sum(docs) FILTER (mask & earlier = 0 AND mask & bit > 0) AS removed,
             sum(docs) FILTER (mask & earlier > 0 AND mask & bit > 0) AS redundant, sum(docs) FILTER (mask = bit) AS unique_fails,
             sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & earlier = 0 AND mask & bit > 0) AS toxic_lost
      FROM c, steps GROUP BY ALL)
    SELECT part, filter_order, step::INT AS step, {", ".join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
           (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
    FROM r"""
