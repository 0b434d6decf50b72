"""License scans by diagonal voting, in DataFrame functions only.

All rolling word 3-grams of every document are hashed and joined to the positions
of the same grams in the license templates (a broadcast table of fixed size); grams
with a word that no template has match nothing and are left out before. A match at
document word d and template word t votes for the diagonal d - t of that template.
Votes are summed per diagonal, and diagonals at most ``gap`` apart are merged (an
inserted or dropped word shifts the rest of a license by one). A merged span is
verified: the grams were compared word by word in the join, and the span counts if
``min_share`` of the template's grams stand in it, each template position counted
once, and fill ``min_dense`` of the words that it reaches over. A template marked exact
counts only where one diagonal holds all its grams, which is to say where its words
stand consecutively. Texts are read once and move in one exchange, the matches only,
with one row that stands for the document.

Nulls and edge cases: a null text counts as empty; texts with fewer than three words
match nothing; no match gives empty labels, score 0 and null first and last words;
overlapping places all count; diagonals that tie are all kept; rows that repeat, in
doc_id, text or both, get a result each; an empty table gives an empty result; only
doc_id and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.llm.common import documents
from gleanwork.llm.license_texts import NOTICES

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, in lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3


def template_words(text: str) -> str:
    return " ".join(re.findall(WORDS, text.lower()))


# The phrases and labels to find (label, exact, words); then the notices.
TEMPLATES = [
    ("mit", True, "under the mit license"),
    ("apache-2", True, "apache license version 2"),
    ("cc-by-nc", True, "cc by nc"),
    *((label, False, template_words(text)) for label, text in NOTICES),
]


def words_of(text: Column) -> Column:
    """The text's words with A-Z in lower case.

    Splitting between words is many times faster than matching them. ``lower`` also changes
    letters beyond ASCII, which are compared with nothing; the one of them that it would turn
    into an ASCII letter is replaced before.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("κ")))
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def _grams(words: Column, known: list[str]) -> Column:
    """array<struct<pos, g0, g1, g2>> of the words' 3-grams, those of known words only."""
    at = F.sequence(F.lit(0), F.size(words) - K)
    hits = F.filter(at, lambda i: F.get(words, i).isin(known) & F.get(words, i + 1).isin(known) & F.get(words, i + 2).isin(known))
    each = F.transform(hits, lambda i: F.struct(i.alias("pos"), *[F.get(words, i + k).alias(f"g{k}") for k in range(K)]))
    return F.when(F.size(words) >= K, each).otherwise(F.array().cast("array<struct<pos:int,g0:string,g1:string,g2:string>>"))


def template_grams(spark: SparkSession, templates=None) -> DataFrame:
    """tid, label, exact, n_grams, tpos, h, t0, t1, t2: the templates' grams with their hash."""
    rows = []
    for tid, (label, exact, words) in enumerate(TEMPLATES if templates is None else templates):
        w = words.split(" ")
        rows += [(tid, label, exact, len(w) - K + 1, i, *w[i : i + K]) for i in range(len(w) - K + 1)]
    df = spark.createDataFrame(rows, "tid int, label string, exact boolean, n_grams int, tpos int, t0 string, t1 string, t2 string")
    return df.withColumn("h", F.xxhash64("t0", "t1", "t2"))


def license_hits(docs: DataFrame, templates=None) -> DataFrame:
    """Matches (uid, doc_id, n_words, tid, label, exact, n_grams, tpos, diagonal), and for every row of docs one with a null tid."""
    known = sorted({w for _, _, words in (TEMPLATES if templates is None else templates) for w in words.split(" ")})
    read = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", words_of(F.col("text")).alias("w"))
    mark = F.array(F.struct(F.lit(None).cast("int").alias("pos"), *[F.lit(None).cast("string").alias(f"g{k}") for k in range(K)]))
    each = read.select("uid", "doc_id", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(mark, _grams(F.col("w"), known))).alias("g"))
    grams = each.select("uid", "doc_id", "n_words", "g.*").withColumn("gh", F.xxhash64("g0", "g1", "g2"))
    same = (F.col("gh") == F.col("h")) & (F.col("g0") == F.col("t0")) & (F.col("g1") == F.col("t1")) & (F.col("g2") == F.col("t2"))
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession, templates)), same, "left").where(F.col("pos").isNull() | F.col("tid").isNotNull())
    return hits.select("uid", "doc_id", "n_words", "tid", "label", "exact", "n_grams", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))


def verified_spans(hits: DataFrame, min_share: float, min_dense: float, gap: int) -> DataFrame:
    """The hits merged to spans (uid, doc_id, n_words, label, exact, first_word, last_word, share), and the documents' own rows, whose label is null."""
    by = ["uid", "doc_id", "n_words", "tid", "label", "exact", "n_grams"]
    order = Window.partitionBy("uid", "tid").orderBy("diagonal", "tpos")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    start = F.when(step.isNull() | (F.col("exact") & (step > 0)) | (step > gap), 1).otherwise(0)
    runs = hits.withColumn("start", start).withColumn("run", F.sum("start").over(order))
    at = F.col("diagonal") + F.col("tpos")
    once = runs.groupBy(*by, "run", "tpos").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    spans = once.groupBy(*by, "run").agg(F.count("tpos").alias("held"), F.min("low").alias("first_word"), (F.max("high") + K - 1).alias("last_word"))
    share = F.col("held") / F.col("n_grams")
    reach = F.col("last_word") - F.col("first_word") - (K - 2)
    holds = (F.col("held") == F.col("n_grams")) & F.col("exact") | ~F.col("exact") & (share >= min_share) & (F.col("held") >= min_dense * reach)
    return spans.withColumn("share", share).where(F.col("tid").isNull() | holds)


def license_spans(docs: DataFrame, min_share: float = 0.6, min_dense: float = 0.5, gap: int = 2, templates=None) -> DataFrame:
    """doc_id, label, exact, first_word, last_word, share: the verified spans."""
    found = verified_spans(license_hits(docs, templates).repartition("uid"), min_share, min_dense, gap)
    return found.where("tid IS NOT NULL").select("doc_id", "label", "exact", "first_word", "last_word", "share")


def scan_licenses(docs: DataFrame, min_share: float = 0.6, min_dense: float = 0.5, gap: int = 2, templates=None) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    exact = F.coalesce(F.col("exact"), F.lit(False))
    found = verified_spans(license_hits(docs, templates).repartition("uid"), min_share, min_dense, gap)
    out = found.groupBy("uid", "doc_id", "n_words").agg(
        F.count_if(exact).alias("n_base"),
        F.min(F.when(exact, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(exact, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return out.drop("uid")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
