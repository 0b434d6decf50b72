"""Sharding by histogram sort, in DataFrame functions only.

Every row gets a 62-bit sort key: 31 bits of its text's hash, then 31 bits that differ
by row. Equal texts are neighbours in that order and stay in one shard: groups of them
above one percent of a shard (no more than a hundred a shard) are dealt to the least
filled shard whole, and the others are never cut. Only a group that no shard has room
for is cut, between two rows. What is left of each shard is filled by histogram sort:
candidate boundaries divide the key range evenly; one pass counts the exact bytes below
them, and only intervals whose bytes hold a wanted splitter beyond the tolerance are
probed again, more finely. The histograms are bounded by the number of splitters, not by
rows. Rows are then exchanged once, on the slice of their shard.

Nulls and edge cases: a null text counts as empty (size: the overhead only, crc32
0); null and repeated doc_ids are rows like others; repeated rows are equal texts; a row
or a group of equal texts up to a shard's share makes its shard at most one percent
larger, a single row beyond that share as much larger as it is; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.llm.common import documents, materialize, narrow_result

KEY_BITS, TEXT_BITS = 62, 31
HALF = 1 << (KEY_BITS - TEXT_BITS)
#: Groups of equal texts above this share of a shard are dealt out before the rest.
LARGE = 0.01


def keyed(docs: DataFrame, overhead: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    half = lambda *c: F.pmod(F.xxhash64(*c), F.lit(HALF))
    rows = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.select(
        "doc_id",
        (F.octet_length("text") + overhead).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        (half("text") * HALF + half("row")).alias("key"),
    )


def deal_groups(rows: DataFrame, shards: int, total: int) -> tuple[list[tuple[int, int]], list[float]]:
    """Large groups of equal texts (half key, shard), each in the shard with most room, and the bytes each shard has then."""
    share = total / shards
    groups = rows.groupBy(F.shiftright("key", KEY_BITS - TEXT_BITS).alias("g")).agg(F.sum("size").alias("bytes"))
    large = groups.where((F.col("bytes") > LARGE * share) & (F.col("bytes") <= share * (1 + LARGE))).collect()  # at most shards / LARGE
    held = [(0, s) for s in range(shards)]
    dealt, filled = [], [0.0] * shards
    for r in sorted(large, key=lambda r: (-r["bytes"], r["g"])):
        load, s = held[0]
        if load + r["bytes"] <= share * (1 + LARGE):
            heapq.heapreplace(held, (load + r["bytes"], s))
            filled[s] += r["bytes"]
            dealt.append((r["g"], s))
    return dealt, filled


def find_splitters(rows: DataFrame, wanted: list[float], slack: list[float], whole: float, first_bits: int = 12, bits: int = 6) -> list[int]:
    """For each number of bytes in ``wanted`` (ascending) the key below which so many lie, within its slack.

    Rows of one text, up to ``whole`` bytes together, are never cut apart.
    """
    found: dict[int, int] = {}
    active, below, width = {0: list(range(len(wanted)))}, {0: 0}, KEY_BITS
    text_width = KEY_BITS - TEXT_BITS
    while active and wanted:
        finer = max(0, width - (first_bits if width == KEY_BITS else bits))
        finer = text_width if finer < text_width < width else finer
        probed = rows
        if width < KEY_BITS:
            at = rows.sparkSession.createDataFrame([(p,) for p in active], "at long")
            probed = rows.join(F.broadcast(at), F.shiftright("key", width) == F.col("at"), "left_semi")
        counted = probed.groupBy(F.shiftright("key", finer).alias("p")).agg(F.sum("size").alias("bytes")).collect()
        inside: dict[int, list] = {}
        for r in counted:
            inside.setdefault(r["p"] >> (width - finer), []).append((r["p"], r["bytes"]))
        nxt: dict[int, list[int]] = {}
        nxt_below: dict[int, float] = {}
        for p, ks in active.items():
            cells, i, low = sorted(inside.get(p, [(p << (width - finer), 0)])), 0, below[p]
            for k in sorted(ks):
                while i + 1 < len(cells) and low + cells[i][1] < wanted[k]:
                    low += cells[i][1]
                    i += 1
                cell, high = cells[i][0], low + cells[i][1]
                near_low = wanted[k] - low <= high - wanted[k]
                one_text = finer <= text_width and cells[i][1] <= whole
                if min(wanted[k] - low, high - wanted[k]) <= slack[k] or one_text or finer == 0:
                    found[k] = (cell if near_low else cell + 1) << finer
                else:
                    nxt.setdefault(cell, []).append(k)
                    nxt_below[cell] = low
        active, below, width = nxt, nxt_below, finer
    return [found[k] for k in range(len(wanted))]


@narrow_result
def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16, slices: int | None = None, tolerance: float = 0.0005) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards of near-equal bytes, slots gapless from 0 in each."""
    spark = docs.sparkSession
    rows = materialize(keyed(docs, overhead))
    total = rows.agg(F.sum("size")).first()[0] or 0
    if slices is None:  # a slice of a shard is one task's sort: about 256 MB of texts, at most 64 slices
        slices = min(64, max(4, total // (shards << 28)))
    dealt, filled = deal_groups(rows, shards, total)
    table = spark.createDataFrame(dealt, "g long, own int")
    rows = rows.join(F.broadcast(table), F.shiftright("key", KEY_BITS - TEXT_BITS) == F.col("g"), "left").drop("g")
    share, rest = total / shards, total - sum(filled)
    room = [max(0.0, share - f) for f in filled]
    scale = rest / sum(room) if sum(room) else 0.0
    wanted, slack, at = [], [], 0.0
    for s in range(shards):  # every slice's end but the last; a shard's own end is met more closely than the slices between
        for i in range(slices):
            at += room[s] * scale / slices
            wanted.append(at)
            slack.append(share * (tolerance if i == slices - 1 else 0.1 / slices))
    splitters = find_splitters(rows.where("own IS NULL"), wanted[:-1], slack[:-1], LARGE * share) if rest else []
    top = KEY_BITS - 12
    table, i = [], 0
    for p in range(1 << 12):  # a splitter on a cell's lower edge is already below every key of the cell
        while i < len(splitters) and splitters[i] <= p << top:
            i += 1
        table.append((p, i, [s for s in splitters[i:] if s < (p + 1) << top]))
    cells = spark.createDataFrame(table, "p int, base int, within array<long>")
    part = F.when(F.col("own").isNotNull(), F.col("own") * slices + F.pmod("key", F.lit(slices))).otherwise(F.col("base") + F.size(F.filter("within", lambda s: s <= F.col("key"))))
    placed = rows.join(F.broadcast(cells), F.shiftright("key", top).cast("int") == F.col("p"), "left").select("doc_id", "size", "text_crc32", "key", part.cast("int").alias("part"))
    sums = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("shard", F.floor(F.col("part") / slices).cast("int"))
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    starts = sums.select("part", "shard", start.alias("start"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("key", "doc_id", "text_crc32")))
    slot = (F.col("start") + F.col("rank") - 1).cast("long")
    return ranked.join(F.broadcast(starts), "part").select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
