"""What the fourth round's review found, each by a small table."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__  # noqa: F401
from gleanwork.plans import pdf_queries, registry
from gleanwork.sources import pdf


def test_files_without_text(spark, tmp_path):  # a sentence stood for texts of white space; ids below 0 lost their sign, and a null one ended the job
    rows = [(0, None), (1, ""), (2, " "), (3, "\n"), (4, "\t \r\n"), (5, "x\x00y"), (6, "a  b\r c \n"), (-7, "below"), (2**53 + 1, "large"), (None, "no key"), (None, None)]
    docs = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], dtype="Int64"), "text": [t for _, t in rows]})
    docs.to_parquet(tmp_path / "documents.parquet")
    df = registry.QUERIES["pdf_documents"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.SQL['pdf_documents']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr) and len(want) == len(rows)


def read_again(text, **how):
    told = pdf.read_pdf(pdf_queries.made_pdf(text, "Document 1", **how))
    assert told[1:] == (1, {"Title": "Document 1", "CreationDate": "D:20240305"}, None)
    return told[0].strip("\n")


def test_long_texts_are_whole():  # what was above 64 MB in a stream was lost
    text = "ab " * 5_700_000
    assert read_again(text) == text


@pytest.mark.parametrize("most", [1, 2, 7, 100])
def test_texts_in_several_streams(most):  # F1
    text = "one line\n\n\nand\ranother, 𝒳 é\nend"
    assert read_again(text, most=most) == text


def test_more_characters_than_codes_of_two_bytes():  # F1
    text = "".join(map(chr, [*range(32, 0xD800), *range(0xE000, 0x11000)]))
    assert len(set(text)) > 1 << 16 and read_again(text) == text
