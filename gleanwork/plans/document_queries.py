"""Queries over documents, labels and conversations: relevance, scores, lint, routing, extraction, descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanwork.functions import extract, lint, route
from gleanwork.functions import text as T
from gleanwork.operators import briefs, signals
from gleanwork.plans import sqltext as S
from gleanwork.plans.page_queries import _score_sql
from gleanwork.plans.registry import query, table

# The driver's prose is invented, so most of the fixed vocabularies never occur in it. The queries add
# terms that do, which makes their results depend on every rule.
TEST_TERMS = [*signals.RELEVANT, "thtion", "enstchö", "eauxment"]
TEST_BANNED = [*lint.BANNED_PHRASES, "the of", "and the", "que de", "thing"]
TEST_REVIEW = [*route.REVIEW, (r"\bthon\b", 12), (r"\bther\b", 14)]
TEST_INSIGHT = [*route.INSIGHT, (r"\bthth\b", 14), (r"\bthre\b", 12)]
TEST_NEWS = [*route.NEWS, (r"\bthes\b|\bthhe\b", 16)]
TEST_VENDOR = [*route.VENDOR, (r"\berthe\b", 25)]
TEST_EQUIPMENT = [*route.EQUIPMENT, r"\bthed\b", r"\bthin\b"]
TEST_PRODUCT = [*route.PRODUCT_LIKE, r"\banea\b", r"\bthor\b"]
TEST_BUYER = [*route.BUYER, r"\bonnd\b"]
TEST_TYPES = [("magazine", ["thtionha"]), ("interview", ["ofthe"]), *extract.DOCUMENT_TYPES, ("notice", ["thing"])]
TEST_VENDORS = [*extract.VENDORS, "Thble", "Eaux", "Schein"]
TEST_TECHNOLOGIES = [*extract.TECHNOLOGIES, "thon", "ther", "than"]
TEST_LINKS = [("license", "/licenses"), ("thing", "/things"), ("the of", "/of"), ("share", "/share")]
KINDS = ["news", "insight", "review", "vendor", "magazine", "article", "other"]


def _kind_sql() -> str:
    return f"{S.strings(KINDS)}[CAST(doc_id % {len(KINDS)} AS INTEGER) + 1]"


def _kind():
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % len(KINDS)).cast("int") + 1)


def _title():
    return F.substring("text", 1, 60)


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text", "lang", "source")


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')"
_NO_HEADS = r"array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: NOT regexp_matches(trim(s), '^##\s+\S')), ' ')"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({_NO_HEADS}, '([.!?])\s+([A-ZА-Я0-9])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s+([A-ZА-Я0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words FROM documents")
def word_counts(spark, folder):
    return _docs(spark, folder).select("doc_id", lint.word_count(F.col("text")).cast("long").alias("n_words"))


@query(f"SELECT doc_id, CAST(len({_SENTENCES}) AS BIGINT) AS n_sentences FROM documents")
def sentence_counts(spark, folder):
    return _docs(spark, folder).select("doc_id", F.size(lint.sentences(F.col("text"))).cast("long").alias("n_sentences"))


_LENGTHS = rf"list_transform({_SENTENCES}, lambda s: len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')))"


@query(f"""WITH l AS (SELECT doc_id, unnest({_LENGTHS}) AS n FROM documents)
SELECT doc_id, round(stddev_pop(n) / avg(n), 6) AS cv, count(*) AS n_sentences FROM l GROUP BY doc_id HAVING count(*) >= 6""")
def sentence_rhythm_cv(spark, folder):
    parts = lint.sentences(F.col("text"))
    out = _docs(spark, folder).select("doc_id", F.round(lint.rhythm(parts), 6).alias("cv"), F.size(parts).cast("long").alias("n_sentences"))
    return out.where("n_sentences >= 6")


@query(f"SELECT doc_id FROM documents WHERE {S.any_of('lower(text)', TEST_TERMS)}")
def relevance_filter(spark, folder):
    return _docs(spark, folder).where(lint.is_relevant(F.col("text"), TEST_TERMS)).select("doc_id")


_DOC_SCORE = _score_sql("text", "source", "source")


@query(f"SELECT doc_id, {_DOC_SCORE} AS score FROM documents")
def editorial_score(spark, folder):
    return _docs(spark, folder).select("doc_id", signals.editorial_score(F.col("text"), F.col("source"), F.col("source")).alias("score"))


@query(f"SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT doc_id, {_DOC_SCORE} AS score FROM documents)")
def ranked_signals(spark, folder):
    score = signals.editorial_score(F.col("text"), F.col("source"), F.col("source"))
    scored = _docs(spark, folder).select(F.col("doc_id").alias("seq"), score.alias("score"))
    return signals.ranked(scored).withColumnRenamed("seq", "doc_id").select("doc_id", "score", "rank")


@query(f"""SELECT doc_id, source, score FROM (SELECT doc_id, source, {_DOC_SCORE} AS score FROM documents)
QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(source, ''), 'unknown') ORDER BY score DESC, doc_id) <= 4 ORDER BY score DESC, doc_id LIMIT 60""")
def diversified_documents(spark, folder):
    score = signals.editorial_score(F.col("text"), F.col("source"), F.col("source"))
    rows = _docs(spark, folder).select(F.col("doc_id").alias("seq"), F.col("source").alias("feed"), score.alias("score"))
    return signals.diversified(rows, 60).select(F.col("seq").alias("doc_id"), F.col("feed").alias("source"), "score")


@query(f"SELECT sha256({S.collapsed('text')}) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_groups(spark, folder):
    return _docs(spark, folder).groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"SELECT doc_id, array_to_string(list_sort({S.topic_tokens('text', T.TOPIC_STOPS)}), ' ') AS tokens FROM documents")
def topic_token_sets(spark, folder):
    tokens = T.topic_tokens(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


_BANNED = f"list_filter({S.strings(TEST_BANNED)}, lambda p: contains(lower(substr(text, 1, 60) || ' ' || text), p))"


@query(f"SELECT doc_id, array_to_string({_BANNED}, '|') AS phrases FROM documents WHERE len({_BANNED}) > 0")
def lint_banned(spark, folder):
    found = lint.banned_phrases(F.concat(_title(), F.lit(" "), F.col("text")), TEST_BANNED)
    return _docs(spark, folder).select("doc_id", F.array_join(found["detail"], "|").alias("phrases")).where("phrases <> ''")


_THREES = rf"len(regexp_extract_all({S.wordy('text')}, '(?i)\b(\w+(?:\s\w+){{0,2}}),\s(\w+(?:\s\w+){{0,2}}),?\sand\s(\w+(?:\s\w+){{0,2}})\b'))"


@query(f"SELECT doc_id, {_THREES} >= 2 AS flagged FROM documents")
def lint_rule_of_three(spark, folder):
    return _docs(spark, folder).select("doc_id", (F.size(lint.rule_of_three(F.col("text"))) > 0).alias("flagged"))


def _bound_sql(i: int) -> str:
    return "CASE " + " ".join(f"WHEN kind = {S.quoted(k)} THEN {v[i]}" for k, v in lint.WORD_RANGES.items()) + f" ELSE {lint.OTHER_RANGE[i]} END"


@query(f"""WITH k AS (SELECT doc_id, {_kind_sql()} AS kind, len({_WORDS}) AS n FROM documents)
SELECT doc_id, kind, CASE WHEN n < {_bound_sql(0)} THEN 'too_short' WHEN n > {_bound_sql(1)} THEN 'too_long' ELSE '' END AS verdict FROM k""")
def lint_word_range(spark, folder):
    issues = lint.word_range(F.col("text"), F.col("kind"))
    return _docs(spark, folder).withColumn("kind", _kind()).select("doc_id", "kind", F.coalesce(F.try_element_at(issues["code"], F.lit(1)), F.lit("")).alias("verdict"))


_TITLE_WORDS = r"list_filter(string_split_regex(substr(text, 1, 60), '\s+'), lambda w: w <> '')"


@query(rf"""SELECT doc_id, regexp_matches(substr(text, 1, 60), '\d') OR regexp_matches({S.wordy('substr(text, 1, 60)')}, '\b[A-Z]{{2,}}\b')
  OR len(list_filter(({_TITLE_WORDS})[2:], lambda w: regexp_matches(w, '^\p{{Lu}}') AND NOT list_contains({S.strings(lint.GENERIC_TITLE_WORDS)}, lower(trim(w, '.,:'))))) > 0 AS specific
FROM documents""")
def lint_title(spark, folder):
    return _docs(spark, folder).select("doc_id", lint.is_specific(_title()).alias("specific"))


_NUM = r"list_distinct(regexp_extract_all({c}, '\b\d[\d,.]*\s?%?\b'))"


@query(f"""WITH f AS (SELECT doc_id, {_NUM.format(c=S.wordy("text"))} AS wanted, {_NUM.format(c=S.wordy("substr(text, 301)"))} AS body FROM documents)
SELECT doc_id, len(wanted) > 0 AND NOT list_has_any(wanted, body) AS ungrounded FROM f""")
def lint_grounding(spark, folder):
    issues = lint.fact_grounding(F.expr("substring(text, 301)"), F.array("text"))
    return _docs(spark, folder).select("doc_id", (F.size(issues) > 0).alias("ungrounded"))


_PARAGRAPHS = r"list_filter(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda p: trim(p, chr(32) || chr(10) || chr(9)) <> '' AND NOT regexp_matches(trim(p, chr(32) || chr(10) || chr(9)), '^##\s+\S'))"
_PARAGRAPH_LENGTHS = rf"list_transform({_PARAGRAPHS}, lambda p: len(list_filter(string_split_regex(p, '\s+'), lambda w: w <> '')))"
_REPORT = rf"""WITH d AS (SELECT doc_id, text, {_kind_sql()} AS kind FROM documents),
l AS (SELECT doc_id, unnest({_LENGTHS}) AS n FROM d), r AS (SELECT doc_id, count(*) AS n, stddev_pop(n) / avg(n) AS cv FROM l GROUP BY doc_id),
pl AS (SELECT doc_id, unnest({_PARAGRAPH_LENGTHS}) AS n FROM d), p AS (SELECT doc_id, count(*) AS n, sqrt(CAST(count(*) * sum(n * n) - sum(n) * sum(n) AS DOUBLE)) / sum(n) AS cv FROM pl GROUP BY doc_id),
parts AS (SELECT d.doc_id, kind, len({_WORDS}) AS n, len(list_filter({S.strings(lint.BANNED_PHRASES)}, lambda p: contains(lower(substr(text, 1, 60) || ' ' || text), p))) AS errors,
  CAST({_THREES} >= 2 AS INTEGER) AS threes, CAST(coalesce(r.n >= 6 AND r.cv < {lint.FLAT_SENTENCES}, false) AS INTEGER) AS flat, CAST(coalesce(p.n >= 4 AND p.cv < {lint.FLAT_PARAGRAPHS}, false) AS INTEGER) AS paragraphs, CAST(len({_WORDS}) < {_bound_sql(0)} OR len({_WORDS}) > {_bound_sql(1)} AS INTEGER) AS out_of_range,
  CAST(list_contains({S.strings(lint.WITH_HEADINGS)}, kind) AND len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(trim(s), '^##\s+\S'))) = 0 AS INTEGER) AS heads,
  CAST(NOT (regexp_matches(substr(text, 1, 60), '\d') OR regexp_matches({S.wordy('substr(text, 1, 60)')}, '\b[A-Z]{{2,}}\b')
    OR len(list_filter(({_TITLE_WORDS})[2:], lambda w: regexp_matches(w, '^\p{{Lu}}') AND NOT list_contains({S.strings(lint.GENERIC_TITLE_WORDS)}, lower(trim(w, '.,:'))))) > 0) AS INTEGER) AS generic
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id),
scored AS (SELECT doc_id, CAST(greatest(0, 100 - 15 * errors - 6 * (threes + flat + paragraphs + heads + generic + out_of_range)) AS INTEGER) AS score, errors > 0 AS has_errors FROM parts)"""


def _reports(spark, folder):
    report = lint.lint_report(_title(), F.col("text"), _kind(), F.array().cast("array<string>"))
    return _docs(spark, folder).select("doc_id", report.alias("r")).select("doc_id", "r.score", "r.has_errors")


@query(f"{_REPORT} SELECT doc_id, score, has_errors FROM scored")
def lint_report_score(spark, folder):
    return _reports(spark, folder)


@query(f"{_REPORT} SELECT scored.doc_id, score, labels.quality, CASE WHEN labels.quality = 0 OR score < 75 THEN 'improve' ELSE 'pass' END AS verdict FROM scored JOIN labels ON labels.doc_id = scored.doc_id")
def quality_gate(spark, folder):
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("l"), "quality")
    verdict = lint.quality_verdict(F.col("quality"), F.col("score"))
    return _reports(spark, folder).join(labels, F.col("doc_id") == F.col("l")).select("doc_id", "score", "quality", verdict.alias("verdict"))


def _section_scores():
    return route.scores(F.col("text"), TEST_REVIEW, TEST_INSIGHT, TEST_NEWS, TEST_VENDOR, TEST_EQUIPMENT, TEST_PRODUCT, TEST_BUYER)


def _first_hits(patterns) -> str:
    return f"array_to_string((list_filter([{', '.join(f'CASE WHEN regexp_matches(words, {S.quoted(p)}) THEN {S.quoted(p)} END' for p, _ in patterns)}], lambda p: p IS NOT NULL))[1:3], ', ')"


_SCORES = f"""WITH s AS (SELECT doc_id, words, {S.weighted('words', TEST_REVIEW)} AS review, {S.weighted('words', TEST_INSIGHT)} AS insight, {S.weighted('words', TEST_NEWS)} AS news,
  {S.weighted('words', TEST_VENDOR)} AS vendor, {S.any_match('words', TEST_EQUIPMENT)} AS equipment, {S.any_match('words', TEST_PRODUCT)} AS product, {S.any_match('words', TEST_BUYER)} AS buyer,
  CASE doc_id % 5 WHEN 0 THEN 'news' WHEN 1 THEN 'insight' END AS explicit, doc_id % 2 = 0 AS sourced FROM (SELECT doc_id, {S.wordy('lower(text)')} AS words FROM documents))"""


def _routed(spark, folder):
    return _docs(spark, folder).select("doc_id", _section_scores().alias("s"), F.when(F.col("doc_id") % 5 == 0, "news").when(F.col("doc_id") % 5 == 1, "insights").alias("explicit"), (F.col("doc_id") % 2 == 0).alias("sourced"))


@query(f"{_SCORES} SELECT doc_id, review, insight, news, vendor, equipment, product, buyer FROM s")
def section_scores(spark, folder):
    return _routed(spark, folder).select("doc_id", *[f"s.{c}" for c in ("review", "insight", "news", "vendor", "equipment", "product", "buyer")])


@query(f"""{_SCORES} SELECT doc_id, CASE
  WHEN vendor >= 25 THEN 'vendor' WHEN buyer AND equipment THEN 'review' WHEN equipment AND product AND review >= 18 THEN 'review'
  WHEN explicit = 'insight' AND equipment AND product AND (review >= 14 OR review > insight + 6) THEN 'review' WHEN explicit = 'insight' THEN 'insight'
  WHEN insight >= greatest(news, review) + 5 AND insight >= 18 THEN 'insight' WHEN explicit = 'news' AND NOT (equipment AND product AND review >= 24) THEN 'news'
  WHEN news > review AND news >= 16 THEN 'news' WHEN review >= 22 AND equipment THEN 'review' WHEN sourced THEN 'news' ELSE 'insight' END AS section,
  CASE
  WHEN vendor >= 25 THEN 0.9 WHEN buyer AND equipment THEN 0.88 WHEN equipment AND product AND review >= 18 THEN 0.84
  WHEN explicit = 'insight' AND equipment AND product AND (review >= 14 OR review > insight + 6) THEN 0.84 WHEN explicit = 'insight' THEN 0.9
  WHEN insight >= greatest(news, review) + 5 AND insight >= 18 THEN 0.82 WHEN explicit = 'news' AND NOT (equipment AND product AND review >= 24) THEN 0.86
  WHEN news > review AND news >= 16 THEN 0.78 WHEN review >= 22 AND equipment THEN 0.78 WHEN sourced THEN 0.62 ELSE 0.6 END::DOUBLE AS confidence,
  CASE WHEN vendor >= 25 OR (buyer AND equipment) THEN '' WHEN equipment AND product AND review >= 18 THEN 'review hits: ' || {_first_hits(TEST_REVIEW)}
  WHEN explicit = 'insight' THEN '' WHEN insight >= greatest(news, review) + 5 AND insight >= 18 THEN 'insight hits: ' || {_first_hits(TEST_INSIGHT)}
  WHEN explicit = 'news' AND NOT (equipment AND product AND review >= 24) THEN '' WHEN news > review AND news >= 16 THEN 'news hits: ' || {_first_hits(TEST_NEWS)} ELSE '' END AS hits FROM s""")
def section_decision(spark, folder):
    decision = route.decide(F.col("s"), route.normalize_section(F.col("explicit")), F.col("sourced"))
    return _routed(spark, folder).select("doc_id", decision.alias("d")).select("doc_id", "d.section", "d.confidence", F.coalesce(F.try_element_at("d.reasons", F.lit(2)), F.lit("")).alias("hits"))


@query(f"SELECT doc_id, CASE lower(trim(source)) {' '.join(f'WHEN {S.quoted(a)} THEN {S.quoted(b)}' for a, b in {**{s: s for s in route.SECTIONS}, **route.ALIASES}.items())} END AS section FROM (SELECT doc_id, (['news', 'Insights', ' guide ', '/news/', 'supplier', ''])[CAST(doc_id % 6 AS INTEGER) + 1] AS source FROM documents)")
def section_aliases(spark, folder):
    names = F.array(*[F.lit(x) for x in ("news", "Insights", " guide ", "/news/", "supplier", "")])
    return _docs(spark, folder).select("doc_id", route.normalize_section(F.element_at(names, (F.col("doc_id") % 6).cast("int") + 1)).alias("section"))


def _types_sql() -> str:
    hay = "lower(substr(text, 1, 60) || ' ' || source || ' ' || substr(text, 1, 3000))"
    return "CASE " + " ".join(f"WHEN {S.any_of(hay, terms)} THEN {S.quoted(name)}" for name, terms in TEST_TYPES) + f" ELSE {S.quoted(extract.OTHER_TYPE)} END"


@query(f"SELECT doc_id, {_types_sql()} AS doc_type FROM documents")
def doc_type(spark, folder):
    return _docs(spark, folder).select("doc_id", extract.document_type(_title(), F.col("text"), F.col("source"), TEST_TYPES).alias("doc_type"))


_HAY = "lower(concat_ws(' ', substr(text, 1, 60), source, '', substr(text, 1, 2500)))"


@query(f"""SELECT doc_id, coalesce((list_filter({S.strings(TEST_VENDORS)}, lambda v: contains({_HAY}, lower(v))))[1], '') AS company,
  array_to_string((list_filter([{', '.join(f"CASE WHEN regexp_matches({S.wordy(_HAY)}, {S.quoted(chr(92) + 'b' + chr(92) + 'Q' + n.lower() + chr(92) + 'E' + chr(92) + 'b')}) THEN {S.quoted(n)} END" for n in TEST_TECHNOLOGIES)}], lambda n: n IS NOT NULL))[1:8], ',') AS technologies
FROM documents""")
def entities(spark, folder):
    found = extract.technologies(_title(), F.col("text"), F.col("source"), names=TEST_TECHNOLOGIES)
    return _docs(spark, folder).select("doc_id", extract.company(_title(), F.col("text"), F.col("source"), vendors=TEST_VENDORS).alias("company"), F.array_join(found, ",").alias("technologies"))


_SRC = f"trim({S.strip_tags('text')})"
_CUT = f"substr({_SRC}, 1, 157)"
_SPACE = f"(length({_CUT}) - strpos(reverse({_CUT}), ' '))"


@query(f"""SELECT doc_id, CASE WHEN length({_SRC}) <= 160 THEN {_SRC} ELSE rtrim(CASE WHEN strpos({_CUT}, ' ') > 0 AND {_SPACE} > 100 THEN substr({_CUT}, 1, {_SPACE}) ELSE {_CUT} END, ',.;: ') || '…' END AS description FROM documents""")
def meta_description(spark, folder):
    return _docs(spark, folder).select("doc_id", T.meta_description(F.col("text"), F.lit("")).alias("description"))


@query(f"SELECT doc_id, array_to_string(list_transform(list_filter({S.strings([k for k, _ in TEST_LINKS])}, lambda k: contains(lower(text), k)), lambda k: k), ',') AS keywords FROM documents")
def internal_links(spark, folder):
    hits = F.filter(F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(u).alias("url")) for k, u in TEST_LINKS]), lambda x: F.contains(F.lower(F.col("text")), x["keyword"]))
    return _docs(spark, folder).select("doc_id", F.array_join(hits["keyword"], ",").alias("keywords"))


_DESCRIPTION = f"""CASE WHEN length({_SRC}) <= 160 THEN {_SRC} ELSE rtrim(CASE WHEN strpos({_CUT}, ' ') > 0 AND {_SPACE} > 100 THEN substr({_CUT}, 1, {_SPACE}) ELSE {_CUT} END, ',.;: ') || '…' END"""


@query(f"""SELECT doc_id, {S.slug('substr(text, 1, 60)', 100)} AS slug, {_DESCRIPTION} AS description,
  len(list_filter({S.strings([k for k, _ in TEST_LINKS])}, lambda k: contains(lower(text), k))) AS n_links FROM documents""")
def seo_package(spark, folder):
    package = briefs.seo_package(_title(), F.col("text"), F.lit(""), TEST_LINKS)
    return _docs(spark, folder).select("doc_id", package.alias("p")).select("doc_id", "p.slug", F.col("p.meta_description").alias("description"), F.size("p.internal_links").cast("long").alias("n_links"))


@query()
def issue_segments(spark, folder):
    """Topics of every document as if it were an issue: vendors it names, then themes."""
    return briefs.segments(_docs(spark, folder), TEST_VENDORS, {"license": ["license"], "thing": ["thing"]})


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT doc_id, unnest(regexp_extract_all(line, '\d+(?:[.,]\d+)?\s*%')) AS v FROM l)
SELECT doc_id, count(*) AS n_percentages FROM m GROUP BY doc_id""")
def percentages(spark, folder):
    lines = _docs(spark, folder).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hits = lines.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"\d+(?:[.,]\d+)?\s*%"), F.lit(0))).alias("v"))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_percentages"))


@query()
def technical_facts(spark, folder):
    """Facts of all documents: see the unit tests for what each rule finds."""
    facts = _docs(spark, folder).select("doc_id", F.posexplode(extract.technical_facts(F.col("text"))).alias("pos", "fact"))
    return facts.select("doc_id", "pos", "fact.parameter", "fact.value")


@query()
def reply_json(spark, folder):
    """JSON found in model replies, as text; null where there is none."""
    found = F.to_json(T.lenient_json(F.col("text")))
    return table(spark, folder, "conversations").select("conv_id", "turn", found.alias("json"))


@query("SELECT doc_id, 'x-' || doc_id || '.pdf' AS name FROM documents")
def upload_names(spark, folder):
    raw = F.concat(F.lit("x-"), F.col("doc_id").cast("string"), F.lit(" (é)/.pdf"))
    return _docs(spark, folder).select("doc_id", T.upload_name(raw).alias("name"))


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(words, {S.quoted(p)}) THEN {S.quoted(p)} END' for p, _ in TEST_REVIEW)}], lambda p: p IS NOT NULL), ' ') AS hits FROM (SELECT doc_id, {S.wordy('lower(text)')} AS words FROM documents)")
def section_hits(spark, folder):
    """The patterns of the review table that each document matches."""
    return _docs(spark, folder).select("doc_id", F.array_join(route.weighted_hits(F.lower(F.coalesce("text", F.lit(""))), TEST_REVIEW), " ").alias("hits"))
