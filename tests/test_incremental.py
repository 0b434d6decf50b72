"""Near-duplicates and scans as streams against their batch operators and plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import text as T
from gleanwork.operators import briefs, dedupe
from gleanwork.streaming import incremental, twins

START = dt.datetime(2024, 1, 1)
WORDS = "red blue green line scan board test unit new old fast slow big small".split()
ITEM = "seq long, title string, source string, published timestamp"


def tokens(title):
    return {w for w in "".join(c for c in (title or "").lower() if c.isascii() and (c.isalnum() or c == " ")).split(" ") if w}


def near(a, b):
    return bool(a and b) and len(a & b) / min(len(a), len(b)) >= 0.85


def greedy(items, url=None, horizon=None):
    """Ids that stay, one after the other; ``url`` and ``horizon`` as far as given."""
    kept = []
    for i, title, at, *rest in sorted(items, key=lambda r: r[0]):
        clash = any(near(tokens(title), tokens(k[1])) and (horizon is None or at - k[2] <= horizon) or (url is not None and k[3] == rest[0]) for k in kept)
        if not clash:
            kept.append((i, title, at, *rest))
    return {k[0] for k in kept}


def titles(seed, n):
    draw = random.Random(seed)
    rows = [(i, " ".join(draw.sample(WORDS, draw.randrange(1, 8))), START + dt.timedelta(hours=i)) for i in range(n)]
    return rows + [(n, "", START + dt.timedelta(hours=n)), (n + 1, None, START + dt.timedelta(hours=n)), (n + 2, "?!", START + dt.timedelta(hours=n))]


def streamed(spark, tmp_path, rows, schema, parts):
    """A stream that reads the rows in ``parts`` files, one after the other."""
    frame = spark.createDataFrame(rows, schema)
    size = -(-len(rows) // parts)
    for k in range(parts):
        frame.where((F.col(frame.columns[0]) >= k * size) & (F.col(frame.columns[0]) < (k + 1) * size)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


@pytest.mark.parametrize(("parts", "horizon"), [(3, 400), (4, 1)])
def test_stream_keeps_what_the_batch_keeps(spark, tmp_path, parts, horizon):
    rows = titles(parts, 90)
    stream = streamed(spark, tmp_path, rows, "id long, title string, at timestamp", parts)
    out = f"file://{tmp_path}/decided"
    decide = incremental.deciding(spark, out, horizon)
    batches = []

    def both(batch, batch_id):
        batches.append((dedupe.materialize(batch), batch_id))
        decide(batch, batch_id)

    pairs = incremental.title_pairs(stream, "1 hour", horizon)
    pairs.writeStream.foreachBatch(both).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    told = lambda: {r["id"]: r["kept"] for r in spark.read.schema(incremental.DECIDED).parquet(out).collect()}
    got = told()
    assert set(got) == {r[0] for r in rows} and len(batches) >= parts
    want = greedy(rows, horizon=dt.timedelta(days=horizon))
    assert {i for i, kept in got.items() if kept} == want
    if horizon == 400:
        frame = spark.createDataFrame(rows, "id long, title string, at timestamp")
        assert {r["id"] for r in dedupe.greedy_keep(frame, "id", T.scan_tokens(F.col("title"))).where("kept").collect()} == want
    for batch, batch_id in batches:  # a replay changes nothing
        decide(batch, batch_id)
    assert told() == got


def some_items(seed, n):
    draw = random.Random(seed)
    return [(i, " ".join(draw.sample(WORDS, draw.randrange(1, 7))), f"http://h/{draw.randrange(n // 3)}", START + dt.timedelta(days=draw.randrange(40))) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_acceptance_equals_a_plain_loop(spark, seed):
    items = some_items(seed, 80) + [(200 + i, None, "http://none/", START + dt.timedelta(days=30)) for i in range(2)] + [(300, "no address", None, START), (301, "no date", "http://d/", None)]
    as_of, since = START + dt.timedelta(days=40), START + dt.timedelta(days=10)
    fresh = [(i, t, at, u) for i, t, u, at in items if u and at and at >= since]
    got = briefs.accepted(spark.createDataFrame(items, ITEM), 30, F.lit(as_of))
    assert {r["seq"] for r in got.collect()} == greedy(fresh, url=True)


def test_a_later_item_of_an_address_enters(spark):
    day = START + dt.timedelta(days=1)
    items = [(1, "red blue green", "http://a/", day), (2, "green red blue", "http://b/", day), (3, "other words here", "http://b/", day), (4, "words here other", "http://c/", day), (5, "more", "http://b/", day)]
    got = briefs.accepted(spark.createDataFrame(items, ITEM), 30, F.lit(day))
    assert {r["seq"] for r in got.collect()} == {1, 3}
    known = spark.createDataFrame([("quite other words", "http://a/"), ("here words other", None)], "title string, source string")
    assert {r["seq"] for r in briefs.accepted(spark.createDataFrame(items, ITEM), 30, F.lit(day), known=known).collect()} == {2, 5} - {5}
    assert briefs.accepted(spark.createDataFrame(items, ITEM).limit(0), 30, F.lit(day)).count() == 0


def test_scans_add_up(spark, tmp_path):
    items, as_of = some_items(9, 75), F.lit(START + dt.timedelta(days=40))
    known = spark.createDataFrame([(items[0][1], "http://k/"), ("quite different", items[5][2])], "title string, source string")
    stream = streamed(spark, tmp_path, items, ITEM, 3)
    out, batches = f"file://{tmp_path}/accepted", []
    accept = incremental.accepting(spark, out, 100, as_of, known=known)

    def both(batch, batch_id):
        batches.append((dedupe.materialize(batch), batch_id))
        accept(batch, batch_id)

    stream.writeStream.foreachBatch(both).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    told = lambda: sorted((r["seq"], r["batch"]) for r in spark.read.schema(incremental.ACCEPTED).parquet(out).collect())
    got, whole = told(), briefs.accepted(spark.createDataFrame(items, ITEM), 100, as_of, known=known)
    assert [i for i, _ in got] == sorted(r["seq"] for r in whole.collect()) and len({b for _, b in got}) == 3
    for batch, batch_id in batches:
        accept(batch, batch_id)
    assert told() == got


def test_counts_of_closed_windows_only(spark, tmp_path):
    rows = [(i, "ab"[i % 2], START + dt.timedelta(hours=5 * i), i % 3 == 0) for i in range(60)]
    stream = streamed(spark, tmp_path, rows, "id long, feed string, at timestamp, ok boolean", 3)
    counted = twins.feed_counts(stream, "feed", "at", "1 day", "1 day", F.col("ok"))
    counted.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
    last = max(r[2] for r in rows) - dt.timedelta(days=1)
    want = {}
    for _, feed, at, ok in rows:
        day = at.date()
        if dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1) <= last:
            seen, kept = want.get((feed, day), (0, 0))
            want[feed, day] = (seen + 1, kept + ok)
    got = {(r["feed"], r["window"]["start"].date()): (r["seen"], r["kept"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == want
