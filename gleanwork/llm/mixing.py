"""Mixing sources to target weights, in DataFrame functions only.

Tokens are summed per source, the sums give each source a repetition rate, and
every document is emitted floor(rate) times plus one Bernoulli copy whose
probability is the rate's fraction; the draw is a hash of seed and doc_id, or of the
text where there is no id, so reruns and lost executors give the same mix. Sources may
be as many as documents: they are ranked by range and the level of their targets is
found by sums over them, of which single numbers come to the driver.

Nulls and edge cases: a null source is a source of its own, ordered last; a null
or empty text has size 0 and is taken as 0 words (``mixed`` still emits it as
often as its draw says); a source whose texts are all empty has target and rate
0; an empty table gives an empty result; repeated rows share their doc_id's draw;
other columns pass through ``mixed`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm.common import documents, materialize, unit_hash, word_count
from gleanwork.operators.checkpoints import numbered


def source_rates(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """source, source_size, target, rate from (source, size) rows.

    Sources by code point take the weights in turn and share ``budget`` times all sizes. A
    target stops at ``max_repeat`` times its source's size; what is over is shared again by
    weight: the level rises with each source that is capped, until no other is above its cap.
    """
    sums = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    src = numbered(sums, [F.col("source").asc_nulls_last()], "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    src = materialize(src.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(max_repeat))).alias("cap")))
    total = float(src.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, before = 0.0, -1
    while True:
        capped = F.col("cap") <= F.col("w") * F.lit(level)
        n, spent, free = src.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        if n == before or not free:
            break
        level, before = (total - spent) / free, n
    target = F.when(capped, F.col("cap")).otherwise(F.col("w") * F.lit(total - (spent or 0.0)) / F.lit(free or 1.0))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return src.select("source", "source_size", target.alias("target")).withColumn("rate", rate)


def draw_key(doc_id: Column, text: Column) -> Column:
    """What a document's draw is made of: its id, or else its text."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))


def copies(rate: Column, key: Column, seed: str) -> Column:
    """floor(rate), plus one with the probability of the fraction."""
    return (F.floor(rate) + F.when(unit_hash(seed, key) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix_plan(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies for every document; texts are read once."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw_key(F.col("doc_id"), F.col("text")).alias("key")))
    rates = source_rates(sized, **how).withColumnRenamed("source", "rated")
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("rated")), "left")
    return joined.select("doc_id", "size", "source_size", "target", "rate", copies(F.col("rate"), F.col("key"), seed).alias("copies"))


def mixed(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The mix itself: every document's row as often as its copies say, with its own columns."""
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    rates = source_rates(sized, **how).select(F.col("source").alias("__rated"), F.col("rate").alias("__rate"))
    joined = docs.join(rates, docs["source"].eqNullSafe(F.col("__rated")), "left")
    n = copies(F.col("__rate"), draw_key(docs["doc_id"], docs["text"]), seed)
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), n))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "rate")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sums
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM placed
), levels AS (
  SELECT *, cap <= w * (total - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM weighed
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * (total - sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER ())
              / sum(CASE WHEN capped THEN 0.0 ELSE w END) OVER () END AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets
), drawn AS (
  SELECT doc_id, size, source_size, target, rate,
         CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || key), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE
              < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies, rate FROM drawn
"""
