"""What a run leaves behind: JSON tables of a scan, articles with their metadata, registry files, table descriptions.

Rows are written by Spark's own writers, a folder for each table; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_summary(signals: DataFrame, duplicates: DataFrame, topics: DataFrame, as_of: Column, **settings) -> DataFrame:
    """One row: when, with which settings, and how many signals, duplicates and topics."""
    counts = [("signal_count", signals), ("duplicate_signal_count", duplicates), ("topic_count", topics)]
    each = [df.select(F.lit(name).alias("name")) for name, df in counts]
    n = each[0].unionByName(each[1]).unionByName(each[2]).groupBy().pivot("name", [name for name, _ in counts]).count()
    told = [F.lit(v).alias(k) for k, v in settings.items()]
    return n.select(F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), *told, *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name, _ in counts])


def write_scan(folder: str, signals: DataFrame, duplicates: DataFrame, topics: DataFrame, as_of: Column, **settings) -> None:
    """summary, signals, duplicate_signals and topics as JSON lines below a folder."""
    for name, df in (("summary", scan_summary(signals, duplicates, topics, as_of, **settings)), ("signals", signals), ("duplicate_signals", duplicates), ("topics", topics)):
        df.write.mode("overwrite").json(f"{folder}/{name}")


def article_files(articles: DataFrame, as_of: Column) -> DataFrame:
    """(id, article, meta) of articles (id, title, body, summary, category, tags, section, section_path, sources): the text file and its metadata as JSON."""
    summary = F.coalesce(F.nullif("summary", F.lit("")), F.concat(F.rtrim(F.substring("body", 1, 200)), F.lit("…")))
    first = F.coalesce(F.try_element_at("sources", F.lit(1))["url"], F.lit(""))
    meta = F.struct(
        "title", first.alias("source_url"), summary.alias("summary"), "category", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("section").alias("editorial_type"), "section_path", F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
    )
    return articles.where(F.trim(F.coalesce("body", F.lit(""))) != "").select("id", F.concat("title", F.lit("\n\n"), "body", F.lit("\n")).alias("article"), F.to_json(meta).alias("meta"))


def with_part(meta: Column, name: str, part: Column) -> Column:
    """Metadata (a JSON object) with one more part (a JSON value), such as a rating, a package for search engines or a distribution.

    Of parts with the same name the last counts, as JSON readers take it.
    """
    open_ = F.regexp_replace(F.trim(meta), r"\s*\}$", "")
    return F.concat(open_, F.when(open_ == "{", "").otherwise(","), F.to_json(F.array(F.lit(name))).substr(F.lit(2), F.lit(len(name) + 2)), F.lit(":"), part, F.lit("}"))


def registry_yaml(sources: DataFrame) -> DataFrame:
    """(source_type, value): each source as one YAML list entry, in flow style, which is JSON; null fields are left out."""
    fields = [c for c in sources.columns if c != "source_type"]
    return sources.select("source_type", F.concat(F.lit("- "), F.to_json(F.struct(F.col("source_type").alias("source_type"), *fields))).alias("value"))


def write_registry(folder: str, sources: DataFrame) -> None:
    """A folder of YAML files for each source type, which ``registry_files`` reads."""
    registry_yaml(sources).repartition("source_type").write.mode("overwrite").partitionBy("source_type").text(folder)


def described(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, place, column, type, nullable) of some tables."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "`table` string, place int, `column` string, type string, nullable boolean")
