"""What the third round's review found, each by a small table."""

import datetime as dt
import itertools
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from gleanwork.functions import extract
from gleanwork.functions import text as T
from gleanwork.functions import url as U
from gleanwork.operators import briefs, dedupe, expand, near
from gleanwork.plans import registry, table_queries
from gleanwork.sources import pdf
from gleanwork.streaming import incremental


def same_as_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr) and want


def pages_of(folder, titles):
    html = [f"<html><head><title>{t}</title></head><body><p>{t} text {i}</p></body></html>" for i, t in enumerate(titles)]
    pd.DataFrame({"page_id": range(len(titles)), "url": [f"http://h{i % 5}.example/{i}" for i in range(len(titles))], "html": html}).to_parquet(folder / "pages.parquet")
    return folder


def some_titles(n, seed=7):
    draw = random.Random(seed)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    return [" ".join(draw.sample(words, draw.randint(1, 6))) for _ in range(n)]


def test_titles_without_slug(spark, tmp_path):  # F3
    titles = ["one thing here", "ДВА СЛОВА", "ТРИ СЛОВА", "ЕЩЁ ТРИ", "four things there", "five people"]
    same_as_sql(spark, pages_of(tmp_path, titles), "submitted_drafts", "pages")
    made = registry.QUERIES["submitted_drafts"](spark, str(tmp_path)).collect()
    assert [r["slug"] for r in made if r["seq"] in (1, 2, 3)] == ["", "", ""]


def test_open_days_count(spark, tmp_path):  # F4
    ts = [dt.datetime(2024, 1, d, h) for d in (1, 2, 3) for h in (1, 23)]
    pd.DataFrame({"event_id": range(6), "event_type": ["a", "b"] * 3, "user_id": range(6), "value": [10.0, 30.0] * 3, "ts": pd.Series(ts).astype("datetime64[us]")}).to_parquet(tmp_path / "events.parquet")
    got = {(r["event_type"], r["day"].day): (r["seen"], r["kept"]) for r in registry.QUERIES["stream_daily_counts"](spark, str(tmp_path)).collect()}
    assert got == {(t, d): (1, int(t == "b")) for t in "ab" for d in (1, 2, 3)}


def overlaps(a, b):
    return len(a & b) / min(len(a), len(b))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 40)
    monkeypatch.setattr(near, "BATCH", 50)


@pytest.mark.parametrize("threshold", [0.28, 0.85])
def test_cells_hold_all_pairs(spark, small_blocks, threshold):  # F1, F2, F11
    sets = {i: set(t.split()) for i, t in enumerate(some_titles(70))}
    df = spark.createDataFrame([(i, sorted(k)) for i, k in sets.items()], "id long, tokens array<string>")
    want = {(a, b): overlaps(sets[a], sets[b]) for a, b in itertools.combinations(sets, 2) if overlaps(sets[a], sets[b]) >= threshold}
    rows = dedupe.similar_within(df, threshold).collect()
    assert {(r["a"], r["b"]): r["score"] for r in rows} == want and len(rows) == len(want)
    left, right = df.where("id % 3 = 0").withColumn("below", F.lit(1.0)), df.where("id % 3 <> 0")
    got = {(r["a"], r["b"]) for r in dedupe.similar_pairs(left, right, threshold).collect()}
    assert got == {(a, b) for a in sets for b in sets if a % 3 == 0 and b % 3 and threshold <= overlaps(sets[a], sets[b]) < 1}


def test_no_candidates_are_shuffled(spark):  # F1, F2, F8, F11: pairs that share a frequent word are no rows
    df = spark.range(400).select("id", F.array(F.lit("the"), *[F.concat(F.lit(f"w{i}-"), F.col("id").cast("string")) for i in range(9)]).alias("tokens"))
    plan = dedupe.similar_within(df, 0.28)._jdf.queryExecution().toString()
    assert "Join" not in plan
    assert dedupe.similar_within(df, 0.28).isEmpty()


def test_picks_of_cells(spark, small_blocks):  # of each cell stay a few, and the picks are the same
    titles = some_titles(90, 3)
    s = spark.createDataFrame([(i, t, "", f"http://h{i * i % 7}.example/{i}") for i, t in enumerate(titles)], "seq long, title string, snippet string, source string")
    topics = s.select(F.col("seq").alias("topic_id"), F.col("title").alias("text"), F.lit(True).alias("has_primary"), "source")
    taken = topics.select("topic_id", U.host(F.col("source")).alias("domain"))
    addresses = s.select("seq", F.col("source").alias("url"))
    few, every = expand.related(topics, s, taken=taken, room=2), expand.related(topics, s)
    picks = [{tuple(r) for r in expand.diverse(x.join(addresses, "seq"), taken, 2).select("topic_id", "seq", "domain", "score", "place").collect()} for x in (few, every)]
    assert picks[0] == picks[1] and few.count() < every.count()


def test_greedy_in_cells(spark, small_blocks, tmp_path):  # F5, F8
    titles = [*some_titles(60), "", "...", *some_titles(30)]
    sets, kept = [set(T_ for T_ in t.split() if T_ != "...") for t in titles], []
    for i, k in enumerate(sets):
        if not k or all(not sets[j] or overlaps(k, sets[j]) < 0.85 for j in kept):
            kept.append(i)
    for name in ("neardup_greedy_keep", "stream_neardup_titles"):
        got = registry.QUERIES[name](spark, str(pages_of(tmp_path, titles))).collect()
        assert sorted(r["seq"] for r in got if r["kept"]) == kept and len(got) == len(titles)


def test_batches_and_horizon(spark, tmp_path):  # F5
    day = dt.datetime(2024, 1, 1)
    rows = [(1, day, "a b c"), (2, day, "a b c d"), (3, day + dt.timedelta(9), "x y"), (4, day + dt.timedelta(11), "a b c"), (5, day + dt.timedelta(12), "a b c"), (6, day + dt.timedelta(12), None)]
    df = spark.createDataFrame(rows, "id long, at timestamp, title string")
    decide = incremental.deciding_sets(spark, f"{tmp_path}/out", 10, T.scan_tokens(F.col("title")))
    for n, some in enumerate(("id < 3", "id IN (3, 4)", "id IN (3, 4)", "id > 4")):  # the second batch comes twice
        decide(df.where(some), n - (n > 1))
    got = {r["id"]: r["kept"] for r in spark.read.schema(incremental.KEPT).parquet(f"{tmp_path}/out").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True}


def test_names_and_words(spark):  # the search before the pattern loses nothing
    df = spark.createDataFrame([(1, "EAUX and Äb\nsome thing\nÉtoile"), (2, "xeauxy saki"), (3, "koh-young, AOI spis"), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["kind"], r["name"], r["excerpt"]) for r in briefs.segments(df, ["Eaux", "Saki", "Koh Young", "Äb"], {"t": ["Thing", "none"]}).collect()}
    assert got == {(1, "vendor", "Eaux", "EAUX and Äb"), (1, "theme", "t", "some thing"), (2, "vendor", "Saki", "xeauxy saki"), (3, "vendor", "Koh Young", "koh-young, AOI spis")}
    told = df.select("doc_id", extract.technologies(F.lit(""), F.col("text"), F.lit(""), names=["AOI", "SPI", "Äb"]).alias("t"), extract.company(F.lit(""), F.col("text"), F.lit(""), vendors=["SAKI", "Eaux"]).alias("c"))
    assert {r["doc_id"]: (r["t"], r["c"]) for r in told.collect()} == {1: (["Äb"], "Eaux"), 2: ([], "SAKI"), 3: (["AOI"], ""), 4: ([], "")}


@pytest.mark.parametrize("name", ["issue_segments", "entities"])
def test_text_is_lowered_few_times(spark, name):  # it was written out once for each name
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") < 10


def test_facts_are_spread(spark, tmp_path, monkeypatch):  # a small file of parts was one task
    monkeypatch.setattr(table_queries, "PARTS_A_TASK", 10)
    pd.DataFrame({"p_partkey": range(100), "p_size": range(100)}).astype({"p_size": "int32"}).to_parquet(tmp_path / "part.parquet")
    df = registry.QUERIES["stated_facts"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 11 and df.count() == 600


def test_addresses_are_built_once(spark):  # a filter wrote the address out at each of its uses
    df = registry.QUERIES["context_links"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("utm_") < 8


def test_tokens_of_pdf_files():  # white space and comments took a step each, and files a batch each
    assert pdf.TOKEN.match(b" \n% a (\r\n 12 ", 0).group(1) == b"12" and pdf.TOKEN.match(b" % end", 0).group(1) is None
    told = list(pdf.values(b"% x\n<< /A [1 2 0 R <4 1> ] /B (a\\)) >> % y\nfoo  ", 0))
    assert [v for v, _ in told] == [{"A": [1, 2, b"\x41"], "B": b"a)"}, b"foo"]
    widths = [pdf.Known({1: "a", 0x4142: "b"})]
    assert widths[0][1] == "a" and widths[0][7] == ""


@pytest.fixture
def small_cells(monkeypatch):
    for name, n in {"BLOCK": 7, "BATCH": 50, "FEW": 5, "LEAST_CELLS": 9}.items():
        monkeypatch.setattr(near, name, n)


@pytest.mark.parametrize("held", [60, 1000])  # beyond it there are more blocks
@pytest.mark.parametrize("threshold", [0.28, 0.85])
def test_several_indexes_of_a_cell(spark, small_cells, monkeypatch, threshold, held):  # F2, F11
    monkeypatch.setattr(near, "HELD", held)
    sets = {i: set(t.split()) for i, t in enumerate(some_titles(70))}
    df = spark.createDataFrame([(i, sorted(k)) for i, k in sets.items()], "id long, tokens array<string>")
    want = {(a, b): overlaps(sets[a], sets[b]) for a, b in itertools.permutations(sets, 2) if overlaps(sets[a], sets[b]) >= threshold}
    rows = dedupe.similar_within(df, threshold).collect()
    assert {(r["a"], r["b"]): r["score"] for r in rows} == {k: v for k, v in want.items() if k[0] < k[1]} and len({(r["a"], r["b"]) for r in rows}) == len(rows)
    rows = dedupe.similar_pairs(df.where("id % 3 = 0"), df.where("id % 3 <> 0"), threshold).collect()
    assert {(r["a"], r["b"]): r["score"] for r in rows} == {k: v for k, v in want.items() if k[0] % 3 == 0 and k[1] % 3} and len({(r["a"], r["b"]) for r in rows}) == len(rows)
    rows = near.found(df, df, threshold, earlier=True).collect()
    assert {r["a"] for r in rows} == {a for a, b in want if b < a}


def dealt(spark, monkeypatch, n, joined):
    """How many rows are dealt for n rows against themselves."""
    df = spark.range(n).select("id", F.array(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("tokens"))
    with monkeypatch.context() as m:
        seen, deal = [], near._dealt
        m.setattr(near, "BLOCK", 40)
        m.setattr(near, "_dealt", lambda *a: seen.append(deal(*a)) or seen[-1])
        joined(df)
        return sum(d.count() for d in seen)


JOINS = {"F2": lambda df: near.pairs(df, df, 0.28), "F8": lambda df: near.found(df, df, 0.85, earlier=True), "F11": lambda df: near.within(df, 0.85)}


@pytest.mark.parametrize("name", JOINS)
def test_rows_are_dealt_as_often_in_larger_tables(spark, monkeypatch, name):  # 16 times the rows were dealt 256 times as often
    assert dealt(spark, monkeypatch, 32_000, JOINS[name]) == 16 * dealt(spark, monkeypatch, 2000, JOINS[name])


def test_greedy_in_several_indexes(spark, small_cells, monkeypatch, tmp_path):  # F8
    monkeypatch.setattr(near, "HELD", 90)
    same_as_sql(spark, pages_of(tmp_path, [*some_titles(90), "", "...", *some_titles(30)]), "neardup_greedy_keep", "pages")


def test_accepted_in_several_indexes(spark, small_cells, monkeypatch, tmp_path):  # what a task holds has bounds, and the choice is the same
    monkeypatch.setattr(near, "HELD", 90)
    same_as_sql(spark, pages_of(tmp_path, [*some_titles(120), "", "..."]), "accepted_items", "pages")
    for n in (10**3, 10**6, 10**9):
        assert near._grid(n, n, 9 * n, 24, False)[1] * near.HELD >= 9 * n and near._grid(n, n, 9 * n, 24, True)[1] * near.HELD >= 9 * n
