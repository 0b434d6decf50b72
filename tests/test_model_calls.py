"""Model calls: each request once, the cache, failures as rows; drafts, revisions, repairs and checks."""

import datetime as dt
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from gleanwork.operators import joins, model_calls, writing
from gleanwork.operators.model_calls import Model

NOW = dt.datetime(2024, 5, 2, 12)
FACTS = "array<string>"


def as_of():
    return F.lit(NOW)


def cache(spark, rows=()):
    return spark.createDataFrame(list(rows), model_calls.CACHE)


def requests(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return rows.withColumn("messages", model_calls.messages("sys", F.col("text")))


def noting(folder, answer):
    """A model that leaves a file for each call."""

    def call(messages, options):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(messages[-1]["content"])
        return answer(messages[-1]["content"])

    return call


def calls(folder):
    return sorted(open(os.path.join(folder, n)).read() for n in os.listdir(folder))


@pytest.mark.parametrize("frequent", [1000, 2])
def test_equal_requests_are_called_once(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(joins, "FREQUENT", frequent)
    texts = ["a"] * 30 + ["b", "c", "b", None, ""]
    asked = model_calls.ask(requests(spark, texts).repartition(4), Model("m", noting(tmp_path, lambda t: f"<{t}>")), cache(spark), as_of())
    got = {r["id"]: r for r in asked.answers.collect()}
    asked.answers.count()  # reading again calls nothing
    assert calls(tmp_path) == ["", "a", "b", "c"]
    assert [got[i]["reply"] for i in range(len(texts))] == [f"<{t or ''}>" for t in texts]
    assert all(r["n_attempts"] == 1 and not r["from_cache"] and r["error"] is None for r in got.values())
    again = model_calls.ask(requests(spark, texts), Model("m", noting(tmp_path, lambda t: "new")), asked.cache, as_of())
    assert {r["reply"] for r in again.answers.collect()} == {"<a>", "<b>", "<c>", "<>"} and len(calls(tmp_path)) == 4
    other = model_calls.ask(requests(spark, ["a"]), Model("other", noting(tmp_path, lambda t: "new")), asked.cache, as_of())
    assert other.answers.first()["reply"] == "new"


def test_expired_entries_are_called_again(spark, tmp_path):
    rows = requests(spark, ["old", "day", "new"])
    key = {r["text"]: r["key"] for r in rows.withColumn("key", model_calls.request_key("m", F.col("messages"))).collect()}
    known = [(key["old"], NOW - dt.timedelta(hours=24, seconds=1), "x"), (key["day"], NOW - dt.timedelta(hours=24), "kept"), (key["new"], NOW - dt.timedelta(hours=30), "y"), (key["new"], NOW, "latest")]
    asked = model_calls.ask(rows, Model("m", noting(tmp_path, lambda t: "called")), cache(spark, known), as_of())
    assert {r["text"]: r["reply"] for r in asked.answers.collect()} == {"old": "called", "day": "kept", "new": "latest"}
    assert calls(tmp_path) == ["old"]
    assert {(r["key"], r["value"]) for r in asked.cache.collect()} == {(key["old"], "called"), (key["day"], "kept"), (key["new"], "latest")}


def test_failures_are_rows(spark, tmp_path):
    def answer(text):
        if text == "third" and sum(open(os.path.join(tmp_path, n)).read() == "third" for n in os.listdir(tmp_path)) < 3:
            raise ConnectionError("busy")
        if text == "never":
            raise ValueError("no " * 500)
        return 5 if text == "number" else "ok"

    asked = model_calls.ask(requests(spark, ["third", "never", "number", "fine", "never"]), Model("m", noting(tmp_path, answer), attempts=3), cache(spark), as_of())
    got = {r["text"]: r for r in asked.answers.collect()}
    assert got["third"]["reply"] == "ok" and got["third"]["n_attempts"] == 3 and got["third"]["error"] is None
    assert got["never"]["reply"] is None and got["never"]["error"].startswith("ValueError: no") and len(got["never"]["error"]) <= 500
    assert got["number"]["error"].startswith("TypeError") and got["fine"]["n_attempts"] == 1
    attempts = [(r["attempt"], r["error"] is None) for r in asked.attempts.orderBy("attempt").collect()]
    assert len(attempts) == 3 + 3 + 3 + 1 and sum(ok for _, ok in attempts) == 2
    assert asked.cache.count() == 2


def test_no_requests(spark, tmp_path):
    asked = model_calls.ask(requests(spark, ["x"]).limit(0), Model("m", noting(tmp_path, str)), cache(spark), as_of())
    assert asked.answers.count() == 0 and asked.cache.count() == 0 and calls(tmp_path) == []


def test_json_in_replies(spark):
    said = ['{"a": 1, "b": ["x"]}', 'Sure!\n```json\n{"a": 2}\n```', '{"a": "text", "b": "no list"}', "[1, 2]", "none", None, '{"a": 3']
    rows = spark.createDataFrame([(i, r, None) for i, r in enumerate(said)], "id long, reply string, error string")
    got = model_calls.parsed(rows, "a bigint, b array<string>").orderBy("id").collect()
    assert [(r["value"]["a"], r["value"]["b"]) if r["value"] else None for r in got] == [(1, ["x"]), (2, None), (None, None), None, None, None, None]
    assert [r["error"] is None for r in got] == [True, True, True, False, False, False, False]


LONG = " ".join(f"word{i}" for i in range(400))
GOOD = {"title": "TR7600 line scan", "body": f"The unit has 12 lanes.\n\n{LONG}", "tags": ["t"]}


def article(title, body):
    return {"title": title, "body": body, "summary": None, "category": None, "tags": None}


def repaired(spark, folder, articles, answer, rounds=1, facts=()):
    rows = [(i, article(*a), "news", list(facts)) for i, a in enumerate(articles)]
    frame = spark.createDataFrame(rows, f"id long, article struct<title:string,body:string,summary:string,category:string,tags:array<string>>, kind string, facts {FACTS}")
    told, _ = writing.repair(frame, Model("m", noting(folder, answer), attempts=1), cache(spark), as_of(), rounds)
    return {r["id"]: r for r in told.collect()}


def test_only_articles_with_issues_are_mended(spark, tmp_path):
    def answer(prompt):
        if "EMPTY" in prompt:
            return json.dumps({"title": "x", "body": "  "})
        if "FAIL" in prompt:
            raise ValueError("down")
        if "TALK" in prompt:
            return "I can't"
        if "WORSE" in prompt:
            return json.dumps({"title": "news", "body": "cutting-edge game-changer", "repairs_made": ["made it worse"]})
        return json.dumps(GOOD | {"repairs_made": ["title"]})

    bodies = [(GOOD["title"], GOOD["body"]), ("good news", LONG), ("EMPTY", "short"), ("FAIL", "short"), ("WORSE", "short"), ("TALK", "short"), (None, None)]
    got = repaired(spark, tmp_path, bodies, answer)
    assert got[0]["n_repairs"] == 0 and got[0]["article"]["title"] == GOOD["title"] and got[0]["lint_before"]["score"] == 100
    assert got[1]["n_repairs"] == 1 and got[1]["article"]["title"] == GOOD["title"] and got[1]["lint_after"]["score"] == 100 > got[1]["lint_before"]["score"] and got[1]["repairs_made"] == ["title"]
    assert got[2]["article"]["body"] == "short" and got[2]["repair_error"] == "repair has no body" and got[2]["lint_after"] == got[2]["lint_before"]
    assert got[3]["article"]["body"] == "short" and got[3]["repair_error"] == "ValueError: down"
    assert got[4]["article"]["body"].startswith("cutting-edge") and got[4]["lint_after"]["score"] < got[4]["lint_before"]["score"] and got[4]["repair_error"] is None
    assert got[5]["repair_error"] == "reply holds no JSON object"
    assert got[6]["article"]["title"] == GOOD["title"]
    assert len(calls(tmp_path)) == 6 and all(r["n_repairs"] <= 1 for r in got.values())


def test_rounds_are_bounded_and_stop_when_all_is_well(spark, tmp_path):
    def answer(prompt):
        step = prompt.count("step ")
        return json.dumps({"title": "TR7600", "body": LONG + " step " * (step + 1) if "STUBBORN" not in prompt else "STUBBORN " + "step " * (step + 1)})

    got = repaired(spark, tmp_path, [("news", LONG), ("STUBBORN", "STUBBORN"), ("TR7600", LONG)], answer, rounds=3)
    assert [got[i]["n_repairs"] for i in range(3)] == [1, 3, 0]
    assert len(calls(tmp_path)) == 4


BRIEF = f"id long, topic string, angle string, kind string, category string, keywords {FACTS}, key_facts {FACTS}, sources array<struct<title:string,url:string,date:string,role:string,excerpt:string>>"


def test_three_passes(spark, tmp_path):
    prompts = writing.Prompts()

    def call(messages, options):
        system, user = messages[0]["content"], messages[1]["content"]
        with open(os.path.join(tmp_path, uuid.uuid4().hex), "w") as f:
            f.write(system[:9])
        name = user.split("Topic: ")[1].split("\n")[0] if "Topic: " in user else user.split("TITLE: ")[1].split("\n")[0].split()[0]
        if system == prompts.write:
            if name == "dead":
                raise TimeoutError("slow")
            return json.dumps({"title": f"{name} draft", "body": "" if name == "blank" else "first"})
        if system == prompts.revise:
            return {"kept": "{}", "odd": "no"}.get(name) or json.dumps({"title": f"{name} revised", "body": f"{LONG} 12", "category": "Test", "revision_notes": ["tightened"]})
        return json.dumps({"title": "AB-12", "body": f"{LONG} 12 again", "summary": "mended", "repairs_made": ["title"]})

    rows = [(i, t, None, "news", "Cat", ["k"], ["12 lanes"], []) for i, t in enumerate(["plain", "blank", "dead", "kept", "odd"])]
    told, _ = writing.write(spark.createDataFrame(rows, BRIEF), Model("m", call, attempts=2), cache(spark), as_of())
    got = {r["topic"]: r for r in told.collect()}
    assert got["plain"]["title"] == "AB-12" and got["plain"]["draft_title"] == "plain draft" and got["plain"]["summary"] == "mended" and got["plain"]["revision_notes"] == ["tightened"]
    assert got["plain"]["category"] == "Cat" and got["plain"]["tags"] == ["k"] and got["plain"]["lint_after"]["score"] == 100 and got["plain"]["section"] == "news"
    assert got["blank"]["write_error"] == "draft has no body" and got["blank"]["title"] == "blank draft" and got["blank"]["body"] == ""
    assert got["dead"]["write_error"] == "TimeoutError: slow" and got["dead"]["title"] == "dead"
    assert got["kept"]["revision_notes"] == [] and got["odd"]["revision_notes"] == [] and got["odd"]["title"] == "AB-12"
    names = calls(tmp_path)
    assert len([n for n in names if n == prompts.write[:9]]) == 6 and len([n for n in names if n == prompts.revise[:9]]) == 3 and all(r["n_repairs"] in (None, 1) for r in got.values())
    single, _ = writing.write(spark.createDataFrame(rows[:1], BRIEF), Model("m", call), cache(spark), as_of(), revise=False)
    one = single.first()
    assert one["title"] == "plain draft" and one["body"] == "first" and one["n_repairs"] == 0 and one["lint_after"]["score"] < 100 and one["summary"] == "first…"


def test_check_replaces_field_by_field(spark, tmp_path):
    said = {
        "low": {"score": 40, "title": "better", "tags": ["n"], "issues": ["thin"], "breakdown": {"facts": 10}}, "high": {"score": 75, "title": "ignored"},
        "none": {"title": "unrated"}, "talk": "no JSON here", "text": {"score": "high", "body": " new body \n"},
    }

    def call(messages, options):
        name = messages[1]["content"].split("TITLE: ")[1].split("\n")[0]
        if name == "fail":
            raise OSError("gone")
        return said[name] if isinstance(said[name], str) else json.dumps(said[name])

    rows = [(n, "body", "sum", ["o"], "brief") for n in ("low", "high", "none", "talk", "text", "fail")]
    frame = spark.createDataFrame(rows, f"title string, body string, summary string, tags {FACTS}, brief string").withColumn("was", F.col("title"))
    told, _ = writing.check_quality(frame, Model("m", call, attempts=1), cache(spark), as_of())
    got = {r["was"]: r for r in told.collect()}
    assert (got["low"]["title"], got["low"]["body"], got["low"]["summary"], got["low"]["tags"]) == ("better", "body", "sum", ["n"])
    assert got["low"]["quality_check"]["improved"] and not got["low"]["quality_check"]["approved"] and got["low"]["quality_check"]["issues"] == ["thin"] and got["low"]["quality_check"]["breakdown"] == {"facts": 10.0}
    assert got["high"]["title"] == "high" and got["high"]["quality_check"]["approved"] and not got["high"]["quality_check"]["improved"]
    assert got["none"]["title"] == "unrated" and got["none"]["quality_check"]["score"] == 0
    assert got["text"]["body"] == "new body" and got["text"]["quality_check"]["score"] == 0
    assert got["talk"]["quality_check"] is None and got["talk"]["check_error"] == "reply holds no JSON object"
    assert got["fail"]["title"] == "fail" and got["fail"]["quality_check"] is None and got["fail"]["check_error"] == "OSError: gone"
