"""Articles by a model: draft, revision, repair of what the lint finds, and a last check of quality.

Each pass is one ``ask`` over the rows that need it. A pass that fails, or gives an article without
body, leaves the article of the pass before, so no reply ever blocks a row. Repairs are bounded:
only rows with issues are asked again, at most ``rounds`` times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import lint, pages, route
from gleanwork.operators.checkpoints import materialize
from gleanwork.operators.model_calls import Model, ask, messages, parsed

ARTICLE = "title string, body string, summary string, category string, tags array<string>"
REVISED = f"{ARTICLE}, revision_notes array<string>"
REPAIRED = f"{ARTICLE}, repairs_made array<string>"
CHECKED = "score double, approved boolean, issues array<string>, breakdown map<string,double>, title string, body string, summary string, tags array<string>"
NO_NAMES = "array<string>"
LINT = "struct<score:int,has_errors:boolean,word_count:int,sentence_count:int,heading_count:int,issues:array<struct<code:string,detail:string,severity:string>>>"


@dataclass(frozen=True)
class Prompts:
    """What the model is told to be in each pass; each asks for a JSON object."""

    write: str = "You write technical articles. Use only the facts given. Answer with a JSON object: title, body, summary, category, tags."
    revise: str = "You edit a draft against its brief: facts, clichés, repetition, structure, headline. Answer with a JSON object: title, body, summary, category, tags, revision_notes."
    repair: str = "You mend only the problems listed and leave all other text as it is. Answer with a JSON object: title, body, summary, category, tags, repairs_made."
    check: str = "You rate an article from 0 to 100 and, below the bar, improve it. Answer with a JSON object: score, approved, issues, breakdown, title, body, summary, tags."


def _filled(text: Column) -> Column:
    return F.coalesce(F.trim(text, F.lit(" \n\t\r")), F.lit("")) != ""


def _report(kind: Column, facts: Column) -> Column:
    """The lint report of column ``article``."""
    return lint.lint_report(F.coalesce("article.title", F.lit("")), F.coalesce("article.body", F.lit("")), kind, facts).cast(LINT)


def _shown(article: str = "article") -> list[Column]:
    return [F.lit("TITLE: "), F.coalesce(f"{article}.title", F.lit("")), F.lit("\n\nBODY:\n"), F.coalesce(f"{article}.body", F.lit("")), F.lit("\n\n")]


def repair_prompt(facts: Column, issues: Column) -> Column:
    """Column ``article`` with its issues and the facts it may use."""
    listed = F.array_join(F.transform(issues, lambda i: F.concat(F.lit("- ["), i["code"], F.lit("] "), i["detail"])), "\n")
    return F.concat(*_shown(), F.lit("PROBLEMS:\n"), listed, F.lit("\n\nFACTS:\n"), F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n"))


def repair(articles: DataFrame, model: Model, cache: DataFrame, as_of: Column, rounds: int = 1, prompts: Prompts = Prompts()) -> tuple[DataFrame, DataFrame]:
    """``articles`` (article: struct as ``ARTICLE``, kind, facts, and others) after lint and repairs, and the cache.

    Added: lint_before, lint_after, repairs_made, n_repairs (model requests) and repair_error (the last one's). Rows
    without issues aren't asked; a repair is taken if it has a body, whatever its score; a row whose request fails
    or gives no body is asked no more, as the same request would give the same.
    """
    facts = F.coalesce("facts", F.array().cast("array<string>"))
    rows = articles.withColumn("article", F.col("article").cast(f"struct<{ARTICLE.replace(' ', ':').replace(',:', ',')}>"))
    rows = rows.withColumn("lint_before", _report(F.col("kind"), facts)).withColumn("lint_after", F.col("lint_before"))
    rows = materialize(rows.withColumns({"repairs_made": F.array().cast(NO_NAMES), "n_repairs": F.lit(0), "repair_error": F.lit(None).cast("string")}))
    done = None
    for _ in range(rounds):
        open_ = (F.size("lint_after.issues") > 0) & F.col("repair_error").isNull()
        settled = rows.where(~open_)
        done = settled if done is None else done.unionByName(settled)
        todo = rows.where(open_)
        if todo.isEmpty():
            rows = todo
            break
        asked = ask(todo.withColumn("messages", messages(prompts.repair, repair_prompt(facts, F.col("lint_after.issues")))), model, cache, as_of)
        cache = asked.cache
        told = parsed(asked.answers, REPAIRED, "fixed")
        usable = F.coalesce(_filled(F.col("fixed.body")), F.lit(False))
        article = F.when(usable, F.struct("fixed.title", "fixed.body", "fixed.summary", "fixed.category", "fixed.tags")).otherwise(F.col("article"))
        notes = F.when(usable, F.concat("repairs_made", F.coalesce("fixed.repairs_made", F.array().cast(NO_NAMES)))).otherwise(F.col("repairs_made"))
        error = F.when(usable, None).otherwise(F.coalesce("error", F.lit("repair has no body")))
        told = told.withColumns({"repair_error": error, "repairs_made": notes, "article": article, "n_repairs": F.col("n_repairs") + 1}).select(*rows.columns)
        rows = materialize(told.withColumn("lint_after", _report(F.col("kind"), facts)))
    return (rows if done is None else done.unionByName(rows)), cache


def write(briefs: DataFrame, model: Model, cache: DataFrame, as_of: Column, revise: bool = True, rounds: int = 1, prompts: Prompts = Prompts()) -> tuple[DataFrame, DataFrame]:
    """Articles of ``briefs`` (topic, angle, kind, category, keywords, key_facts, sources, and others), and the cache.

    Three passes: draft, revision against the brief, repair of what the lint finds (without ``revise`` the draft
    alone, with its report). Added: title, body, summary, category, tags with what the brief says where the
    reply lacks them, draft_title, revision_notes, the columns of ``repair``, section, section_path and write_error
    where the draft itself failed.
    """
    own = [c for c in briefs.columns if c != "category"]
    prompt = pages.writer_prompt(F.col("topic"), F.col("angle"), F.coalesce("key_facts", F.array().cast(NO_NAMES)), F.col("sources"))
    asked = ask(briefs.withColumn("prompt", prompt).withColumn("messages", messages(prompts.write, F.col("prompt"))), model, cache, as_of)
    draft = materialize(parsed(asked.answers, ARTICLE, "article").withColumn("write_error", F.when(_filled(F.col("article.body")), None).otherwise(F.coalesce("error", F.lit("draft has no body")))))
    draft = draft.select(*briefs.columns, "prompt", "article", "write_error", F.col("article.title").alias("draft_title"), F.array().cast(NO_NAMES).alias("revision_notes"))
    cache, written, failed = asked.cache, draft.where("write_error IS NULL"), draft.where("write_error IS NOT NULL")
    if revise:
        asked = ask(written.withColumn("messages", messages(prompts.revise, F.concat(F.col("prompt"), F.lit("\n\nDRAFT\n"), *_shown()))), model, cache, as_of)
        cache = asked.cache
        told = parsed(asked.answers, REVISED, "edited")
        usable = F.coalesce(_filled(F.col("edited.body")), F.lit(False))
        article = F.when(usable, F.struct("edited.title", "edited.body", "edited.summary", "edited.category", "edited.tags")).otherwise(F.col("article"))
        notes = F.when(usable, F.coalesce("edited.revision_notes", F.array().cast(NO_NAMES))).otherwise(F.col("revision_notes"))
        written = told.withColumns({"revision_notes": notes, "article": article}).select(*draft.columns)
    mended, cache = repair(written.withColumn("facts", F.col("key_facts")), model, cache, as_of, rounds if revise else 0, prompts)
    rows = mended.drop("facts").unionByName(failed, allowMissingColumns=True)
    body = F.trim(F.coalesce("article.body", F.lit("")), F.lit(" \n\t\r"))
    title, tags = F.coalesce("article.title", "topic"), F.coalesce("article.tags", "keywords", F.array().cast(NO_NAMES))
    category = F.coalesce("article.category", F.col("category"))
    summary = F.coalesce("article.summary", F.concat(F.rtrim(F.substring(body, 1, 200)), F.lit("…")))
    filled = rows.withColumns({"title": title, "body": body, "summary": summary, "tags": tags, "__category": category})
    section = route.decide(route.scores(route.routed_text(F.col("title"), F.col("body"), F.col("__category"), F.col("tags"), F.col("prompt"))), route.normalize_section(F.col("kind")), F.lit(False))
    out = filled.withColumn("d", section)
    added = ["title", "body", "summary", F.col("__category").alias("category"), "tags", "draft_title", "revision_notes", "lint_before", "lint_after", "repairs_made", "n_repairs", "repair_error", "write_error"]
    return out.select(*own, *added, "d.section", "d.section_path"), cache


def check_quality(articles: DataFrame, model: Model, cache: DataFrame, as_of: Column, least: float = 75, prompts: Prompts = Prompts()) -> tuple[DataFrame, DataFrame]:
    """``articles`` (title, body, summary, tags, brief: text, and others) with quality_check and check_error, and the cache.

    An article rated below ``least`` gets, field by field, the title, body, summary and tags of the reply, where that has them. A
    reply without a rating rates 0; a request that fails leaves the article as it is, without quality_check.
    """
    prompt = F.concat(F.lit("TITLE: "), F.coalesce("title", F.lit("")), F.lit("\n\nSUMMARY: "), F.coalesce("summary", F.lit("")), F.lit("\n\nBODY:\n"), F.coalesce("body", F.lit("")), F.lit("\n\nBRIEF:\n"), F.coalesce("brief", F.lit("")))
    asked = ask(articles.withColumn("messages", messages(prompts.check, prompt)), model, cache, as_of)
    told = parsed(asked.answers, CHECKED, "said")
    known = F.col("said").isNotNull()
    score = F.coalesce("said.score", F.lit(0.0))
    low = known & (score < least)
    better = {c: F.when(low, F.coalesce(f"said.{c}", F.col(c))).otherwise(F.col(c)) for c in ("title", "summary", "tags")}
    better["body"] = F.when(low, F.trim(F.coalesce("said.body", F.col("body")), F.lit(" \n\t\r"))).otherwise(F.col("body"))
    check = F.struct(
        score.alias("score"), F.coalesce("said.approved", score >= least).alias("approved"), F.coalesce("said.breakdown", F.create_map().cast("map<string,double>")).alias("breakdown"),
        F.coalesce("said.issues", F.array().cast(NO_NAMES)).alias("issues"), low.alias("improved"), as_of.alias("checked_at"),
    )
    kept = [better.get(c, F.col(c)).alias(c) for c in articles.columns]
    return told.select(*kept, F.when(known, check).alias("quality_check"), F.col("error").alias("check_error")), asked.cache
