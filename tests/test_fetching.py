"""Fetching by a fake function: retries in order, each address once, hosts in few tasks."""

import os
import uuid

from pyspark.sql import functions as F

from gleanwork.sources import fetching


def noting(folder, answer):
    def get(url):
        calls = sorted(os.listdir(folder), key=lambda n: int(n.split("-")[0]))
        before = sum(open(os.path.join(folder, n)).read() == url for n in calls)
        with open(os.path.join(folder, f"{len(calls)}-{os.getpid()}-{uuid.uuid4().hex}"), "w") as f:
            f.write(url)
        return answer(url, before)

    return get


def test_retries_and_order(spark, tmp_path):
    def answer(url, before):
        if "flaky" in url and before < 2:
            raise ConnectionError("reset")
        if "gone" in url:
            return 404, b"no"
        return 200, url.encode()

    urls = ["http://h/a", "http://h/flaky", "http://h/gone", "http://h/a", None, "", "http://h/known", "http://H/b"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    made = fetching.attempts(frame, noting(tmp_path, answer), lanes=1, landed=frame.where("url LIKE '%known'"))
    got = {r["url"]: r for r in fetching.responses(made).collect()}
    assert set(got) == {"http://h/a", "http://h/flaky", "http://h/gone", "http://H/b"}
    assert (got["http://h/flaky"]["n_attempts"], bytes(got["http://h/flaky"]["body"]), got["http://h/flaky"]["error"]) == (3, b"http://h/flaky", None)
    assert (got["http://h/gone"]["n_attempts"], got["http://h/gone"]["status"], got["http://h/gone"]["body"], got["http://h/gone"]["error"]) == (3, 404, None, "status 404")
    assert [(r["attempt"], r["error"]) for r in made.where("url LIKE '%flaky'").orderBy("attempt").collect()] == [(1, "ConnectionError: reset"), (2, "ConnectionError: reset"), (3, None)]
    names = sorted(os.listdir(tmp_path), key=lambda n: int(n.split("-")[0]))
    order = [open(os.path.join(tmp_path, n)).read() for n in names]
    # one lane: one worker for the host, one address after the other
    assert len({n.split("-")[1] for n in names}) == 1 and order == ["http://H/b", "http://h/a", *["http://h/flaky"] * 3, *["http://h/gone"] * 3]


def test_no_addresses(spark, tmp_path):
    none = spark.createDataFrame([(None,)], "url string")
    assert fetching.responses(fetching.attempts(none, noting(tmp_path, lambda u, n: (200, b"")))).where(F.col("url").isNotNull()).count() == 0
