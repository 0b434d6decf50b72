"""Queries over events, orders and parts: freshness, ranks, counts, slugs, drafts, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import dates, extract
from gleanwork.functions import text as T
from gleanwork.operators import briefs, checkpoints, drafts, signals, sinks
from gleanwork.plans.registry import query, table
from gleanwork.streaming import twins

EVENTS_AS_OF, ORDERS_AS_OF = "2024-01-20 00:00:00", "2001-07-01 00:00:00"
#: Rows of a task that reads facts from texts.
PARTS_A_TASK = 5000
_E, _O = f"TIMESTAMP '{EVENTS_AS_OF}'", f"TIMESTAMP '{ORDERS_AS_OF}'"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(f"SELECT event_id FROM events WHERE ts BETWEEN {_E} - INTERVAL 7 DAY AND {_E} + INTERVAL 1 DAY")
def fresh_window(spark, folder):
    return table(spark, folder, "events").where(dates.within_lookback(F.col("ts"), 7, _at(EVENTS_AS_OF))).select("event_id")


_DATED = "(SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS placed FROM orders)"
_FRESH = f"placed BETWEEN {_O} - INTERVAL 365 DAY AND {_O} + INTERVAL 1 DAY"


@query(f"SELECT o_orderkey, coalesce({_FRESH}, false) AS strict, coalesce({_FRESH}, true) AS lenient FROM {_DATED} WHERE coalesce({_FRESH}, true)")
def fresh_strict_vs_lenient(spark, folder):
    dated = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("at"))
    both = [dates.is_fresh(F.col("at"), 365, _at(ORDERS_AS_OF), strict).alias(name) for strict, name in ((True, "strict"), (False, "lenient"))]
    return dated.select("o_orderkey", *both).where("lenient")


@query(f"SELECT o_orderkey, coalesce(strftime(placed, '%Y-%m-%d'), 'unknown') AS day FROM {_DATED}")
def iso_dates(spark, folder):
    at = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return table(spark, folder, "orders").select("o_orderkey", dates.iso_or_unknown(at).alias("day"))


_PHRASES = ["today", "yesterday", "3 days ago", "2 weeks ago", "on 2023-12-05 there", "Dec 24, 2023", "5th January 2024", "2024-02-31 or Jan 3, 2024", "nothing"]
_DAY = f"CAST({_E} AS DATE)"
_MEANT = [_DAY, f"{_DAY} - 1", f"{_DAY} - 3", f"{_DAY} - 2 * 7", "DATE '2023-12-05'", "DATE '2023-12-24'", "DATE '2024-01-05'", "DATE '2024-01-03'", "NULL"]


@query(f"SELECT event_id, strftime(CASE event_id % 9 {' '.join(f'WHEN {i} THEN {m}' for i, m in enumerate(_MEANT))} END, '%Y-%m-%d') AS day FROM events")
def free_text_dates(spark, folder):
    said = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("event_id") % 9).cast("int") + 1)
    at = dates.parse_any_date(said, F.lit(EVENTS_AS_OF).cast("timestamp"))
    return table(spark, folder, "events").select("event_id", F.date_format(at, "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 40 AND value > 20")
def head_n_then_filter(spark, folder):
    return signals.first_n(table(spark, folder, "events"), "event_type", 40, "event_id", F.col("value") > 20).select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE value > 20 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 40")
def filter_then_head_n(spark, folder):
    return signals.first_n(table(spark, folder, "events"), "event_type", 40, "event_id", F.col("value") > 20, filter_first=True).select("event_id", "event_type")


@query(f"SELECT o_orderkey, placed FROM {_DATED} ORDER BY placed DESC NULLS LAST, o_orderkey LIMIT 50")
def most_recent_nulls_last(spark, folder):
    dated = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("placed"))
    return dated.orderBy(F.desc_nulls_last("placed"), "o_orderkey").limit(50)


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderkey LIMIT 10")
def urgency_pick(spark, folder):
    return signals.urgent_first(table(spark, folder, "orders"), F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"], "o_orderkey", 10).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 30")
def drafts_top30(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", (F.col("o_orderstatus") != "O").alias("is_published"))
    return drafts.latest_drafts(rows).select(F.col("id").alias("o_orderkey"), "o_orderdate")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE WHEN o_orderkey = 7 THEN 0 ELSE 1 END, o_orderkey) - 1 AS INTEGER) AS idx FROM orders")
def move_to_front(spark, folder):
    keys = table(spark, folder, "orders").select("o_orderkey")
    return signals.moved_to_front(keys, F.col("o_orderkey") == 7, "o_orderkey").select("o_orderkey", "idx")


@query(f"SELECT count(*) FILTER (WHERE o_orderdate >= {_O}) AS created, count(*) FILTER (WHERE o_orderdate >= {_O} AND o_orderstatus = 'F') AS published, count(*) FILTER (WHERE o_orderstatus <> 'F') AS pending FROM orders")
def content_stats(spark, folder):
    items = table(spark, folder, "orders").select(F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "F").alias("is_published"))
    return drafts.content_stats(items, _at(ORDERS_AS_OF))


@query(f"""SELECT count(*) FILTER (WHERE o_orderdate >= {_O}) AS articles_created, count(*) FILTER (WHERE o_orderdate >= {_O} AND o_orderstatus = 'F') AS articles_published, count(*) FILTER (WHERE o_orderstatus <> 'F') AS drafts_pending,
  (SELECT count(*) FROM events WHERE ts >= {_O}) AS videos_created, (SELECT count(*) FROM events WHERE event_type <> 'view') AS video_drafts_pending FROM orders""")
def all_stats(spark, folder):
    videos = table(spark, folder, "events").select(F.col("ts").alias("at"), (F.col("event_type") == "view").alias("is_published"))
    return drafts.all_stats(_drafts(spark, folder).select("at", "is_published"), videos, _at(ORDERS_AS_OF))


@query("""SELECT o_orderpriority, array_to_string(CASE WHEN n > 0 THEN ['review article drafts: ' || n] ELSE [] END || CASE WHEN pub = 0 AND made > 0 THEN ['nothing created was published'] ELSE [] END || ['connect external analytics'], '; ') AS told
FROM (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS n, count(*) AS made, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey < 0) AS pub FROM orders GROUP BY 1)""")
def recommendations(spark, folder):
    status = F.col("o_orderstatus")
    m = table(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.count_if(status == "O").alias("drafts_pending"), F.lit(0).alias("video_drafts_pending"), F.count("*").alias("articles_created"),
        F.count_if((status == "F") & (F.col("o_orderkey") < 0)).alias("articles_published"), F.lit(None).cast("long").alias("sessions"),
        F.lit(None).cast("long").alias("subscribers"), F.lit(None).cast("double").alias("tool_ctr"),
    )
    return drafts.recommendations(m).select("o_orderpriority", F.array_join("recommendations", "; ").alias("told"))


_REG = "coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'source')"
_NUMBERED = "base || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS slug"


@query(f"SELECT p_partkey, {_NUMBERED} FROM (SELECT p_partkey, {_REG} AS base, row_number() OVER (PARTITION BY {_REG} ORDER BY p_partkey) AS n FROM part)")
def registry_ids(spark, folder):
    new = table(spark, folder, "part").select(F.col("p_partkey").alias("seq"), T.registry_slug(F.col("p_name")).alias("base"))
    return drafts.unique_slugs(new, spark.createDataFrame([], "slug string")).select(F.col("seq").alias("p_partkey"), "slug")


@query(f"SELECT p_partkey, {_NUMBERED} FROM (SELECT p_partkey, base, n + 2 * CAST(taken AS INTEGER) AS n FROM (SELECT p_partkey, {_REG} AS base, row_number() OVER (PARTITION BY {_REG} ORDER BY p_partkey) AS n, {_REG} IN ('red-widget', 'blue-bolt') AS taken FROM part))")
def unique_slugs(spark, folder):
    new = table(spark, folder, "part").select(F.col("p_partkey").alias("seq"), T.registry_slug(F.col("p_name")).alias("base"))
    taken = spark.createDataFrame([("red-widget",), ("red-widget-2",), ("blue-bolt",), ("blue-bolt-2",)], "slug string")
    return drafts.unique_slugs(new, taken).select(F.col("seq").alias("p_partkey"), "slug")


@query("SELECT p_type AS id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, folder):
    return signals.repeated(table(spark, folder, "part"), F.col("p_type"))


@query("SELECT s_suppkey, lower(s_name) AS name, s_nationkey FROM supplier WHERE s_acctbal > 0")
def enabled_sources(spark, folder):
    fields = {"s_suppkey": F.col("s_suppkey"), "name": F.lower("s_name"), "s_nationkey": F.col("s_nationkey")}
    return signals.projected(table(spark, folder, "supplier"), F.col("s_acctbal") > 0, fields)


@query("SELECT DISTINCT CAST(floor(value) AS INTEGER) AS whole FROM events WHERE event_type = 'view' AND CAST(floor(value) AS INTEGER) NOT IN (SELECT CAST(floor(value) AS INTEGER) FROM events WHERE event_type = 'error')")
def anti_existing(spark, folder):
    events = table(spark, folder, "events").withColumn("whole", F.floor("value").cast("int"))
    new, old = events.where("event_type = 'view'").select("whole").distinct(), events.where("event_type = 'error'").select("whole").distinct()
    return new.join(old, "whole", "left_anti")


def _drafts(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "F").alias("is_published"))


@query(f"SELECT o_orderkey AS id, o_orderdate AS at, o_orderstatus = 'F' AS is_published FROM orders WHERE NOT (o_orderstatus <> 'F' AND o_orderdate < {_O} - INTERVAL 90 DAY)")
def retention_cleanup(spark, folder):
    return drafts.retention(_drafts(spark, folder), _at(ORDERS_AS_OF))


@query("SELECT o_orderkey AS id, o_orderdate AS at, o_orderstatus = 'F' OR o_orderkey IN (1, 2, 3, 64) AS is_published FROM orders")
def approve_rewrite(spark, folder):
    return drafts.approve(_drafts(spark, folder), [1, 2, 3, 64])


@query("SELECT o_orderkey AS id, o_orderdate AS at, o_orderstatus = 'F' AS is_published FROM orders WHERE o_orderstatus = 'F' OR o_orderkey NOT IN (1, 2, 3, 64)")
def delete_rewrite(spark, folder):
    return drafts.delete_drafts(_drafts(spark, folder), [1, 2, 3, 64])


@query("SELECT o_orderkey AS id, o_orderpriority AS title, CAST(len(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'http://l/' || o_orderkey END, 'http://j/' || o_custkey], lambda u: u IS NOT NULL)) AS BIGINT) AS n_urls FROM orders ORDER BY o_orderkey DESC LIMIT 2000")
def stored_index(spark, folder):
    key = F.col("o_orderkey")
    inside = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("http://j/"), F.col("o_custkey").cast("string")).alias("source_url"))).alias("sources")))
    link = F.when(key % 2 == 0, F.concat(F.lit("http://l/"), key.cast("string")))
    news = table(spark, folder, "orders").select(key.alias("id"), F.col("o_orderpriority").alias("title"), link.alias("link"), F.lit("").alias("source_url"), inside.alias("frontmatter_json"))
    return briefs.stored_index(news).select("id", "title", F.size("urls").cast("long").alias("n_urls"))


_WATCH = "https://www.youtube.com/watch?v="


@query(f"SELECT '{_WATCH}' || event_id AS url, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE CAST(ts AS DATE) >= CAST({_E} - INTERVAL 7 DAY AS DATE) AND event_id % 3 <> 0")
def new_videos(spark, folder):
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    found = events.select(F.col("event_id").cast("string").alias("id"), kind.alias("title"), F.date_format("ts", "yyyyMMdd").alias("upload_date"), kind.alias("channel"), kind.alias("description"))
    known = events.where("event_id % 3 = 0").select(F.concat(F.lit(_WATCH), F.col("event_id").cast("string")).alias("url"))
    return briefs.new_videos(found, known, F.lit(EVENTS_AS_OF).cast("timestamp"), 7).select("url", F.date_format("published", "yyyy-MM-dd").alias("day"))


@query("SELECT coalesce(kind, want) AS kind, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected, coalesce(n, 0) = coalesce(expected, 0) AS matches FROM (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1) FULL JOIN (VALUES ('view', 5::BIGINT), ('nothing', 0::BIGINT)) AS w(want, expected) ON kind = want")
def registry_parity(spark, folder):
    return briefs.parity(table(spark, folder, "events"), "event_type", {"view": 5, "nothing": 0})


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_events(spark, folder):
    """A stream over the landed events that passes each (user, type) once, run until it has read all. The watermark of 400 days bounds its state and is wider than the table."""
    batch = table(spark, folder, "events")
    root = f"{checkpoints.folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/events.parquet*").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    once = twins.first_of(stream, ["user_id", "event_type"], "at", "400 days").drop("at")
    once.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    told = checkpoints.materialize(spark.read.schema(once.schema).parquet(f"{root}/out"))
    checkpoints.remove(spark, root)
    return told


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS seen, count(*) FILTER (WHERE value > 20) AS kept FROM events GROUP BY ALL")
def stream_daily_counts(spark, folder):
    """Seen and kept per type and day by the streaming twin, run until it has read all; every batch replaces the table by the counts so far, those of days still open too."""
    batch = table(spark, folder, "events")
    root = f"{checkpoints.folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/events.parquet*").select("event_type", "value", F.col("ts").cast("timestamp").alias("at"))
    counted = twins.feed_counts(stream, "event_type", "at", "1 day", "1 day", F.col("value") > 20).select("event_type", F.to_date("window.start").alias("day"), "seen", "kept")
    spark.createDataFrame([], counted.schema).write.parquet(f"{root}/out")
    keep = lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out")  # noqa: E731  in complete mode a batch holds all so far
    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    told = checkpoints.materialize(spark.read.schema(counted.schema).parquet(f"{root}/out"))
    checkpoints.remove(spark, root)
    return told


@query(f"""SELECT o_orderkey, sha256('{{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}}') AS hash, strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') AS moment FROM orders""")
def hashed_requests(spark, folder):
    """The hash of a request's fields, and its local time (two hours ahead) as a moment."""
    rows = table(spark, folder, "orders")
    moment = dates.in_zone(F.col("o_orderdate"), "Etc/GMT-2")
    return rows.select("o_orderkey", T.request_hash({"status": F.col("o_orderstatus"), "key": F.col("o_orderkey")}).alias("hash"), F.date_format(moment, "yyyy-MM-dd HH:mm").alias("moment"))


@query("""SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS drafts_pending, count(*) AS articles_created, 5.0::DOUBLE AS sessions, 0.25::DOUBLE AS tool_ctr, NULL::DOUBLE AS subscribers FROM orders""")
def merged_metrics(spark, folder):
    counts = table(spark, folder, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("drafts_pending"), F.count("*").alias("articles_created"))
    return drafts.merged_metrics(counts, {"sessions": 3, "subscribers": None, "tool_ctr": None}, {"tool_ctr": 0.25, "sessions": 5})


@query("""SELECT p_partkey AS id, p_name || chr(10) || chr(10) || p_type || ' of ' || p_brand || chr(10) AS article,
  '{"title":"' || p_name || '","source_url":"http://s/' || p_partkey || '","summary":"' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_type || ' of ' || p_brand || '…' END || '","category":"' || p_brand || '","tags":["' || p_type || '"],"editorial_type":"news","section_path":"/news/","generated_at":"2001-07-01T00:00:00","quality":{"size":' || p_size || '}}' AS meta FROM part""")
def article_files(spark, folder):
    """Articles and their metadata as files, with a rating added later."""
    p = table(spark, folder, "part")
    articles = p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat_ws(" of ", "p_type", "p_brand").alias("body"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("summary"), F.col("p_brand").alias("category"),
        F.array("p_type").alias("tags"), F.lit("news").alias("section"), F.lit("/news/").alias("section_path"), F.array(F.struct(F.concat(F.lit("http://s/"), F.col("p_partkey").cast("string")).alias("url"))).alias("sources"),
    )
    files = sinks.article_files(articles, F.lit(ORDERS_AS_OF).cast("timestamp")).join(p.select(F.col("p_partkey").alias("k"), "p_size"), F.col("id") == F.col("k"))
    return files.select("id", "article", sinks.with_part(F.col("meta"), "quality", F.to_json(F.struct(F.col("p_size").alias("size")))).alias("meta"))


@query("""SELECT 'vendor' AS source_type, '- {"source_type":"vendor","id":"s-' || s_suppkey || '","name":"' || s_name || '","priority":' || s_nationkey || '}' AS value FROM supplier""")
def registry_entries(spark, folder):
    rows = table(spark, folder, "supplier").select(F.lit("vendor").alias("source_type"), F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("priority"))
    return sinks.registry_yaml(rows)


@query("""SELECT * FROM (VALUES ('region', 1, 'r_regionkey', 'int', true), ('region', 2, 'r_name', 'string', true), ('nation', 1, 'n_nationkey', 'int', true), ('nation', 2, 'n_name', 'string', true), ('nation', 3, 'n_regionkey', 'int', true)) AS t("table", place, "column", type, nullable)""")
def described_tables(spark, folder):
    return sinks.described({t: table(spark, folder, t) for t in ("region", "nation")})


@query("""WITH v AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type = 'view')
SELECT CAST((SELECT max(event_id) FROM events) + n AS BIGINT) AS id, 'e' || event_id AS title, false AS is_published FROM v UNION ALL SELECT event_id, 'old', true FROM events WHERE event_type <> 'view'""")
def inserted_videos(spark, folder):
    events = table(spark, folder, "events")
    top = events.where("event_type <> 'view'").select(F.col("event_id").alias("id"), F.lit("old").alias("title"), F.lit(True).alias("is_published"))
    last = events.agg(F.max("event_id")).first()[0]  # the views' ids count as taken
    found = events.where("event_type = 'view'").select(F.col("event_id").alias("seq"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("title"))
    marker = events.where("event_type <> 'view'").limit(1).select(F.lit(last).alias("id"), F.lit("marker").alias("title"), F.lit(True).alias("is_published"))
    return drafts.insert_videos(top.unionByName(marker), found, _at(EVENTS_AS_OF)).where("title <> 'marker'").select("id", "title", "is_published")


@query("""SELECT p_partkey, pos, parameter, value FROM (SELECT p_partkey, unnest([
  {'pos': 0, 'parameter': 'throughput', 'value': (p_size * 100) || ' cph'}, {'pos': 1, 'parameter': 'accuracy', 'value': p_size || ' um accuracy'},
  {'pos': 2, 'parameter': 'first_pass_yield', 'value': p_size || '%'}, {'pos': 3, 'parameter': 'first_pass_yield', 'value': (p_size + 1) || '%'},
  {'pos': 4, 'parameter': 'pcb_size', 'value': p_size || ' x 10'}, {'pos': 5, 'parameter': 'weight', 'value': p_size || ' kg'}], recursive := true) FROM part)""")
def stated_facts(spark, folder):
    """Facts of a text of five lines about each part."""
    size = F.col("p_size").cast("string")
    lines = [
        F.concat(F.lit("Throughput "), (F.col("p_size") * 100).cast("string"), F.lit(" cph on line 1")), F.concat(F.lit("Accuracy of "), size, F.lit(" um accuracy")),
        F.concat(F.lit("First pass yield is "), size, F.lit("% good. "), (F.col("p_size") + 1).cast("string"), F.lit("% of boards fail.")),
        F.concat(F.lit("PCB size: "), size, F.lit(" x 10")), F.concat(F.lit("weight - "), size, F.lit(" kg")),
    ]
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    spread = parts.repartition(1 + parts.count() // PARTS_A_TASK, "p_partkey")  # few bytes, much work: a split of the file would be one long task
    facts = spread.select("p_partkey", F.posexplode(extract.technical_facts(F.concat_ws("\n", *lines))).alias("pos", "f"))
    return facts.select("p_partkey", "pos", "f.parameter", "f.value")
