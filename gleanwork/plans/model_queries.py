"""Queries that call a model: replies with their cache, repairs of what the lint finds, checks of quality.

The models here are plain functions of the request, so that SQL can say what they answer. They fail, answer
without JSON, or give an article without body, depending on the length of the text they are asked about.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from gleanwork.operators import model_calls, writing
from gleanwork.plans import document_queries as D
from gleanwork.plans import sqltext as S
from gleanwork.plans.registry import query, table

AS_OF = "2024-06-01 00:00:00"


def counting(messages: list[dict], options: dict) -> str:
    text = messages[-1]["content"]
    if len(text) % 7 == 0:
        raise ValueError("overloaded")
    if len(text) % 5 == 0:
        return "nothing to say"
    return f'Here it is:\n```json\n{{"chars": {len(text)}, "digest": "{hashlib.md5(text.encode()).hexdigest()}"}}\n```'


def mending(messages: list[dict], options: dict) -> str:
    head, _, rest = messages[-1]["content"].partition("\n\nBODY:\n")
    body = rest.rpartition("\n\nPROBLEMS:\n")[0]
    if len(body) % 7 == 0:
        raise ValueError("overloaded")
    if len(body) % 5 == 0:
        return json.dumps({"title": "nothing", "body": " \n"})
    return json.dumps({"title": "TR7600 " + head.removeprefix("TITLE: "), "body": body + "\n\n## TR7600\n", "repairs_made": ["title", "heading"]})


def rating(messages: list[dict], options: dict) -> str:
    head, _, rest = messages[-1]["content"].partition("\n\nBODY:\n")
    body = rest.rpartition("\n\nBRIEF:\n")[0]
    n = len(body)
    if n % 13 == 0:
        raise ValueError("overloaded")
    said = {"score": n % 101, "issues": ["odd"] if n % 2 else [], "breakdown": {"facts": n % 25}, "tags": ["rated"]}
    if n % 3:
        said["title"] = "Rated " + head.removeprefix("TITLE: ").partition("\n\nSUMMARY: ")[0]
    return json.dumps(said)


def _empty_cache(spark):
    return spark.createDataFrame([], model_calls.CACHE)


@query("""WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM conversations),
early AS (SELECT t, min(conv_id % 3) AS age FROM r WHERE conv_id % 2 = 0 GROUP BY t),
k AS (SELECT r.*, coalesce(20 * age <= 24, false) AS cached FROM r LEFT JOIN early USING (t))
SELECT conv_id, turn, CASE WHEN cached THEN 0 WHEN n % 7 = 0 OR n % 5 = 0 THEN NULL ELSE n END AS chars, CASE WHEN cached THEN 'early' WHEN n % 7 = 0 OR n % 5 = 0 THEN NULL ELSE md5(t) END AS digest,
  CASE WHEN cached THEN 0 WHEN n % 7 = 0 THEN 3 ELSE 1 END AS n_attempts, cached AS from_cache,
  CASE WHEN cached THEN NULL WHEN n % 7 = 0 THEN 'ValueError: overloaded' WHEN n % 5 = 0 THEN 'reply holds no JSON object' END AS error FROM k""")
def model_replies(spark, folder):
    """Every turn of every conversation is a request; the even conversations' were asked before, some too long ago."""
    model = model_calls.Model("counting", counting)
    as_of = F.lit(AS_OF).cast("timestamp")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", model_calls.messages("You count.", F.col("text")).alias("messages"))
    hours = F.make_dt_interval(hours=(F.col("conv_id") % 3 * 20).cast("int"))
    early = turns.where("conv_id % 2 = 0").select(model_calls.request_key(model.name, F.col("messages")).alias("key"), (as_of - hours).alias("at"), F.lit('{"chars": 0, "digest": "early"}').alias("value"))
    asked = model_calls.ask(turns, model, early, as_of)
    told = model_calls.parsed(asked.answers, "chars bigint, digest string")
    return told.select("conv_id", "turn", "value.chars", "value.digest", "n_attempts", "from_cache", "error")


_AFTER = f"""100 - 15 * errors - 6 * (threes + flat + paragraphs + CAST(n + 2 < {D._bound_sql(0)} OR n + 2 > {D._bound_sql(1)} AS INTEGER))"""


@query(f"""{D._REPORT}, j AS (SELECT parts.*, scored.score, length(text) AS chars, substr(text, 1, 60) AS title, (errors + threes + flat + paragraphs + heads + generic + out_of_range > 0) AS asked
  FROM parts JOIN scored USING (doc_id) JOIN documents USING (doc_id))
SELECT doc_id, score AS score_before, CAST(CASE WHEN asked AND chars % 7 <> 0 AND chars % 5 <> 0 THEN greatest(0, {_AFTER}) ELSE score END AS INTEGER) AS score_after,
  CAST(asked AS INTEGER) AS n_repairs, CASE WHEN asked AND chars % 7 = 0 THEN 'ValueError: overloaded' WHEN asked AND chars % 5 = 0 THEN 'repair has no body' END AS repair_error,
  CASE WHEN asked AND chars % 7 <> 0 AND chars % 5 <> 0 THEN 'TR7600 ' || title ELSE title END AS title FROM j""")
def repaired_articles(spark, folder):
    """Every document as an article: linted, mended once where there are issues, linted again."""
    docs = table(spark, folder, "documents")
    none = F.lit(None).cast("string")
    article = F.struct(D._title().alias("title"), F.col("text").alias("body"), none.alias("summary"), none.alias("category"), F.array().cast("array<string>").alias("tags"))
    rows = docs.select("doc_id", article.alias("article"), D._kind().alias("kind"), F.array().cast("array<string>").alias("facts"))
    told, _ = writing.repair(rows, model_calls.Model("mending", mending), _empty_cache(spark), F.lit(AS_OF).cast("timestamp"))
    return told.select("doc_id", F.col("lint_before.score").alias("score_before"), F.col("lint_after.score").alias("score_after"), "n_repairs", "repair_error", "article.title")


@query("""WITH r AS (SELECT doc_id, text, substr(text, 1, 60) AS title, length(text) AS n FROM documents), k AS (SELECT *, n % 13 = 0 AS failed, n % 101 < 75 AS low FROM r)
SELECT doc_id, CASE WHEN NOT failed AND low AND n % 3 <> 0 THEN 'Rated ' || title ELSE title END AS title, CASE WHEN NOT failed AND low THEN 'rated' ELSE lang END AS tags, NOT failed AND n % 101 >= 75 AS approved,
  CASE WHEN NOT failed THEN CAST(n % 101 AS DOUBLE) END AS score, NOT failed AND low AS improved, CASE WHEN NOT failed THEN CASE WHEN n % 2 = 1 THEN 'odd' ELSE '' END END AS issues,
  CASE WHEN NOT failed THEN CAST(n % 25 AS DOUBLE) END AS facts, CASE WHEN failed THEN 'ValueError: overloaded' END AS error FROM k JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""")
def quality_checked(spark, folder):
    """Every document as an article before it is published: rated, and below 75 replaced field by field."""
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", D._title().alias("title"), F.col("text").alias("body"), F.lit("").alias("summary"), F.array("lang").alias("tags"), F.lit("").alias("brief"))
    told, _ = writing.check_quality(rows, model_calls.Model("rating", rating), _empty_cache(spark), F.lit(AS_OF).cast("timestamp"))
    q = F.col("quality_check")
    return told.select(
        "doc_id", "title", F.array_join("tags", ",").alias("tags"), F.coalesce(q["approved"], F.lit(False)).alias("approved"), q["score"].alias("score"),
        F.coalesce(q["improved"], F.lit(False)).alias("improved"), F.array_join(q["issues"], ",").alias("issues"), q["breakdown"]["facts"].alias("facts"), F.col("check_error").alias("error"),
    )
