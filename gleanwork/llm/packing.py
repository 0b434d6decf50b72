"""Packing token sequences by cutting-stock column generation.

Documents are tokenized once; whole multiples of the sequence length become full
pieces, what is left of each document is one shorter piece. Pieces are items of classes of
``GRAIN`` tokens, and so many short ones of equal length are bundled to one item that
little is lost to the grain. The histogram of classes is the cutting-stock problem: a
linear program over patterns (multisets of classes that fit one sequence) is solved by
column generation, where knapsack dynamic programming prices new patterns with the
program's duals. Where whole pieces leave too much room, pieces longer than ``BUNDLED``
may also be cut in two: a cut is a column that turns a class into two smaller ones, at a
small cost. Cuts are rounded to whole hash buckets of a class, whose counts the histogram
has, so the lengths after cutting are known exactly, and the program is solved for those.
Rounded pattern counts fix how many sequences of each kind there are; pieces of a length
are ranked and a piece's rank says which sequence and place it takes. All that moves
narrow rows, and token ids join their piece's place at the end. Only the histogram, at
most 352 lengths x 256 buckets, comes to the driver, whatever the corpus.

Padding: an item loses fewer than ``GRAIN`` tokens, which is under 3 percent of a piece
longer than ``BUNDLED``, 0.7 percent on average at 512, and as little for bundles; the
program stops within 0.1 percent of its optimum; with cuts that optimum loses at most
about ``CUT_COST`` of a sequence for each cut; rounding leaves at most one part-filled
sequence per class. ``max_pivots`` bounds the program's work; should it end there, only
padding suffers.

Nulls and edge cases: a null or empty text is the end id alone; a document of any
length is tokenized whole, in pieces cut where the tokenizer cuts too; repeated rows
are packed each; rows without doc_id are packed with a null doc_id; an empty table
gives an empty result; only doc_id and text are read. A sequence is padded to ``size``
unless its total is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.llm.common import documents, materialize, narrow_result, release_memory
from gleanwork.llm.tokenize import encoder

BUCKETS = 256
GRAIN = 8
#: Pieces up to so many tokens are bundled, longer ones may be cut.
BUNDLED = 256
#: What a cut costs, in sequences; and the share of room in whole-piece patterns up to which nothing is cut.
CUT_COST, ROOM = 0.005, 0.015
#: Bytes of ids that a task gathers before it hands them on.
FLUSH = 1 << 22
#: One encoder for each path and worker.
_encoders: dict = {}
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"
ARROW_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int) -> DataFrame:
    """Every document's pieces: full ones of ``size`` ids and one with the rest; ids are little-endian unsigned 32-bit numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = encoder(tokenizer_path)
        encode, end = _encoders[tokenizer_path], np.array([end_id], dtype="<u4").tobytes()
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW_PIECES.types, strict=True)], schema=ARROW_PIECES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for at in range(0, len(ids), 4 * size):
                    part = ids[at : at + 4 * size]
                    rows.append((doc_id.as_py(), at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part))
                    held += len(part) + 64
                    if held > FLUSH:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()
        rows.clear()
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def kind_column(length: Column, size: int) -> Column:
    """What a piece is counted as: its length up to ``BUNDLED``, beyond that the next multiple of ``GRAIN``."""
    rounded = F.least(F.lit(size), F.ceil(length / GRAIN) * GRAIN)
    return F.when(length <= min(BUNDLED, size), length).otherwise(rounded).cast("int")


def bundle_size(kind: int) -> int:
    """How many pieces of this length lose at most 1 percent to the grain together, or else least, within twice ``BUNDLED`` tokens."""
    if kind > BUNDLED:
        return 1
    share = {k: k * kind / (-(-k * kind // GRAIN) * GRAIN) for k in range(1, 2 * BUNDLED // kind + 1)}
    return next((k for k, s in share.items() if s >= 0.99), max(share, key=share.get))


def items_of(counts: dict[int, int]) -> tuple[dict[int, int], dict[int, list[tuple[int, int, int, int, int]]]]:
    """Items per class, and for each kind its runs of ranks: lo, hi, pieces in an item, the items' class and the first item's rank in it."""
    items: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for kind, n in sorted(counts.items()):
        together, lo = bundle_size(kind), 0
        for k in dict.fromkeys((together, 1)):
            c, m = -(-k * kind // GRAIN), (n - lo) // k
            if m:
                runs.setdefault(kind, []).append((lo, lo + m * k, k, c, items.get(c, 0)))
                items[c] = items.get(c, 0) + m
                lo += m * k
    return items, runs


def price(lengths: np.ndarray, duals: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack table: the best dual value in each capacity, and the item that was added last (-2: one unit stays empty)."""
    best, last = np.zeros(size + 1), np.full(size + 1, -2, dtype=np.int64)
    fit = np.searchsorted(lengths, np.arange(size + 1), side="right").tolist()
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        if fit[c]:
            value = duals[: fit[c]] + best[c - lengths[: fit[c]]]
            i = int(value.argmax())
            if value[i] > best[c]:
                best[c], last[c] = value[i], i
    return best, last


def pattern_at(lengths: np.ndarray, last: np.ndarray, room: int, first: int | None = None) -> np.ndarray:
    a = np.zeros(len(lengths))
    if first is not None:
        a[first] += 1
        room -= lengths[first]
    while room > 0:
        if last[room] == -2:
            room -= 1
        else:
            a[last[room]] += 1
            room -= lengths[last[room]]
    return a


def solve_patterns(
    lengths: np.ndarray, counts: np.ndarray, size: int, cuttable: np.ndarray | None = None, cut_cost: float = CUT_COST, gap: float = 1e-3, columns: int = 24, max_pivots: int = 4000
) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int, int], float]]:
    """Patterns (rows), how often each is used, and cuts (class, first, rest: indices of lengths), in the linear program.

    ``cuttable``: how many pieces of each length may be cut; without it none are. Each has a row of
    its own, so what was cut is not cut again. Stops within ``gap`` of the optimum or after
    ``max_pivots`` changes of the basis.
    """
    m = len(lengths)
    caps = np.flatnonzero(cuttable) if cuttable is not None else np.zeros(0, dtype=np.int64)
    per, k = (size // lengths).astype(np.float64), len(caps)
    basis, cost = np.diag(np.concatenate([per, np.ones(k)])), np.concatenate([np.ones(m), np.zeros(k)])
    x = np.concatenate([counts / per, cuttable[caps] if k else []])
    inverse, duals, pivots = np.diag(1.0 / np.diag(basis)), cost / np.diag(basis), 0
    names: list[tuple | str] = ["pattern"] * m + ["spare"] * k
    rest = np.full((k, m), -1)  # the class of what is left of a cuttable class after a first part of class j
    ladder = {int(n): i for i, n in enumerate(lengths)}
    for row, i in enumerate(caps.tolist()):
        for j in range(i):
            rest[row, j] = ladder.get(int(lengths[i] - lengths[j]), -1)

    def enter(a: np.ndarray, c: float, name: tuple | str, least: float) -> bool:
        nonlocal x, duals, inverse
        worth = duals @ a
        if worth <= c + least:
            return False
        d = inverse @ a
        ratio = np.where(d > 1e-9, x / np.maximum(d, 1e-9), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            return False
        step = ratio[r]
        x = np.maximum(x - step * d, 0.0)
        x[r], basis[r], cost[r], names[r] = step, a, c, name
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        duals = duals + (c - worth) * row
        return True

    def column(*entries: tuple[int, float]) -> np.ndarray:
        a = np.zeros(m + k)
        for i, v in entries:
            a[i] += v
        return a

    while pivots < max_pivots:
        before = pivots
        if k:
            for row in np.flatnonzero(duals[m:] > gap):
                pivots += enter(column((m + row, 1.0)), 0.0, "spare", gap / 4)
            gain = np.where(rest >= 0, (duals[caps] + duals[m:])[:, None] - duals[None, :m] - duals[rest], -np.inf)
            firsts = gain.argmax(axis=1)
            gains = gain[np.arange(k), firsts]
            for row in np.argsort(-gains)[:columns]:
                i, j, left = int(caps[row]), int(firsts[row]), int(rest[row, firsts[row]])
                if gains[row] > cut_cost + gap / 4:
                    pivots += enter(column((i, 1.0), (m + row, 1.0), (j, -1.0), (left, -1.0)), cut_cost, (i, j, left), gap / 4)
        best, last = price(lengths, duals[:m], size)
        if best[size] > 1 + gap:
            through = duals[:m] + best[size - lengths]
            for first in [None, *np.argsort(-through)[:columns]]:
                pivots += enter(np.concatenate([pattern_at(lengths, last, size, first), np.zeros(k)]), 1.0, "pattern", gap / 2)
        if pivots == before:
            break
    used = np.array([n == "pattern" for n in names], dtype=bool)
    cuts: dict[tuple[int, int, int], float] = {}
    for name, n in zip(names, x, strict=True):
        if isinstance(name, tuple) and n > 0:
            cuts[name] = cuts.get(name, 0.0) + float(n)
    return basis[used, :m], x[used], cuts


def round_patterns(lengths: np.ndarray, counts: np.ndarray, patterns: np.ndarray, x: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns (length: copies) and their numbers of sequences, which use up every count."""
    left, out = counts.astype(np.int64).copy(), []
    whole = patterns.astype(np.int64)
    taken = np.zeros(len(x), dtype=np.int64)
    for p in np.argsort(-x, kind="stable"):
        on = whole[p] > 0
        if on.any():
            taken[p] = min(int(x[p] + 1e-6), int((left[on] // whole[p][on]).min()))
            left -= taken[p] * whole[p]
    for p in np.argsort(-(x - taken), kind="stable"):
        if x[p] > taken[p] and (left >= whole[p]).all():
            taken[p] += 1
            left -= whole[p]
    out = [({int(lengths[i]): int(whole[p][i]) for i in np.flatnonzero(whole[p])}, int(taken[p])) for p in np.flatnonzero(taken)]
    rest: dict[tuple, int] = {}
    while left.any():  # what rounding leaves, at most a few items per pattern: the largest that fits first
        room, used = size, {}
        top = len(lengths)
        while True:
            top = min(top, int(np.searchsorted(lengths, room, side="right")))
            i = np.flatnonzero(left[:top])
            if not len(i):
                break
            i = int(i[-1])
            n = int(min(left[i], room // lengths[i]))
            used[int(lengths[i])] = n
            left[i] -= n
            room -= n * int(lengths[i])
            top = i
        key = tuple(used.items())
        rest[key] = rest.get(key, 0) + 1
    return out + [(dict(k), n) for k, n in rest.items()]


def choose_cuts(counts: dict[int, np.ndarray], size: int) -> tuple[dict[int, list[tuple[int, int, int]]], dict[int, int]]:
    """Per kind the runs of buckets that are cut (lo, hi, tokens of the first part), and the exact number of pieces per kind after that.

    ``counts``: per kind shorter than ``size``, its pieces in each bucket.
    """
    after = {kind: int(n.sum()) for kind, n in sorted(counts.items())}
    if not after:
        return {}, {}
    room = size // GRAIN
    items, _ = items_of(after)
    _, x, _ = solve_patterns(*_present(items), room)
    filled = sum(c * n for c, n in items.items()) / room
    if x.sum() * (1 - ROOM) <= filled:
        return {}, after
    classes = np.arange(1, room)
    n = np.array([items.get(c, 0) for c in classes.tolist()], dtype=np.float64)
    # a little demand everywhere keeps the program from standing still where no piece has that length
    thin = n + 1e-4 * n.sum() / len(n) * (1 + np.arange(len(n)) / len(n))
    long = np.array([counts[c * GRAIN].sum() if c * GRAIN > BUNDLED and c * GRAIN in counts else 0 for c in classes.tolist()], dtype=np.float64)
    _, _, cuts = solve_patterns(classes, thin, room, long)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    wanted: dict[int, list[tuple[float, int]]] = {}
    for (i, j, _), y in cuts.items():
        wanted.setdefault(int(classes[i]) * GRAIN, []).append((y, int(classes[j]) * GRAIN))
    for kind, found in wanted.items():
        ends, at, asked = np.concatenate([[0], np.cumsum(counts[kind])]), 0, 0.0
        for y, first in sorted(found, reverse=True):
            asked = min(asked + y, float(ends[-1]))
            hi = max(at, int(np.abs(ends - asked).argmin()))
            moved = int(ends[hi] - ends[at])
            if moved:
                runs.setdefault(kind, []).append((at, hi, first))
                for k, d in ((kind, -moved), (first, moved), (kind - first, moved)):
                    after[k] = after.get(k, 0) + d
            at = hi
    return runs, {c: k for c, k in sorted(after.items()) if k}


def _present(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    found = sorted(counts.items())
    return np.array([c for c, _ in found], dtype=np.int64), np.array([n for _, n in found], dtype=np.float64)


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """For each class, the runs of ranks [lo, hi) that go to the sequences of one pattern, ``copies`` to each, from place ``at`` on."""
    runs: dict[int, list[tuple]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for pattern, n in plan:
        place = 0
        for c, copies in sorted(pattern.items(), reverse=True):
            lo = ranks.get(c, 0)
            ranks[c] = lo + copies * n
            runs.setdefault(c, []).append((lo, ranks[c], base, copies, place))
            place += copies
        base += n
    return list(runs.items())


def cut_pieces(wide: DataFrame, runs: dict[int, list[tuple[int, int, int]]]) -> DataFrame:
    """uid, at, doc_id, start, length, ids_crc32, doc_tokens, kind: the pieces after cutting; ``at`` is where a part begins in its piece."""
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("length").alias("n"), F.col("kind").alias("kind"), F.col("ids_crc32").alias("crc")))
    parts, rows = whole, wide
    if runs:
        table = wide.sparkSession.createDataFrame(list(runs.items()), "cut_kind int, cuts array<struct<lo: int, hi: int, first: int>>")
        rows = wide.join(F.broadcast(table), F.col("kind") == F.col("cut_kind"), "left")
        hit = F.filter("cuts", lambda s: (s["lo"] <= F.col("bucket")) & (F.col("bucket") < s["hi"]))
        rows, first = rows.withColumn("first", F.try_element_at(hit, F.lit(1))["first"]), F.col("first")
        left = F.struct(F.lit(0).alias("at"), first.alias("n"), first.alias("kind"), F.crc32(F.substring("ids", F.lit(1), 4 * first)).alias("crc"))
        right = F.struct(first.alias("at"), (F.col("length") - first).alias("n"), (F.col("kind") - first).alias("kind"), F.crc32(F.substring("ids", 4 * first + 1, 4 * (F.col("length") - first))).alias("crc"))
        parts = F.when(first.isNotNull(), F.array(left, right)).otherwise(whole)
    rows = rows.select("uid", "doc_id", "start", "doc_tokens", F.explode(parts).alias("p"))
    return rows.select("uid", F.col("p.at").alias("at"), "doc_id", (F.col("start") + F.col("p.at")).alias("start"), F.col("p.n").cast("long").alias("length"), F.col("p.crc").alias("ids_crc32"), "doc_tokens", F.col("p.kind").alias("kind"))


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece, and with ``with_ids`` its ids, as little-endian unsigned 32-bit numbers.

    ``size`` is a multiple of ``GRAIN``.
    """
    spark = docs.sparkSession
    wide = materialize(pieces(docs, tokenizer_path, size, end_id).withColumn("uid", F.monotonically_increasing_id()), "zstd")
    wide = wide.withColumn("kind", kind_column(F.col("length"), size)).withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(BUCKETS)).cast("int"))
    full, short = 0, {}
    for r in wide.groupBy("kind", "bucket").agg(F.count("*").alias("n")).collect():
        if r["kind"] == size:
            full += r["n"]
        else:
            short.setdefault(r["kind"], np.zeros(BUCKETS, dtype=np.int64))[r["bucket"]] = r["n"]
    runs, counts = choose_cuts(short, size)
    cut = materialize(cut_pieces(wide, runs))
    room = size // GRAIN
    items, of_kind = items_of(counts)
    plan = [({room: 1}, full)] if full else []
    of_kind |= {size: [(0, full, 1, room, 0)]} if full else {}
    if items:
        classes, n = _present(items)
        patterns, x, _ = solve_patterns(classes, n, room)
        plan += round_patterns(classes, n, patterns, x, room)
    kinds = spark.createDataFrame(list(of_kind.items()), "k_kind int, k_runs array<struct<lo: long, hi: long, pieces: long, class: int, first: long>>")
    taking = spark.createDataFrame(slots(plan), "slot_class int, runs array<struct<lo: long, hi: long, base: long, copies: long, at: long>>")
    spread = max(64, (full + sum(counts.values())) // 100_000)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("uid", "at"), F.lit(spread)).cast("int"))
    sums = dealt.groupBy("kind", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("part")) - F.col("n")
    before = sums.select(F.col("kind").alias("b_kind"), F.col("part").alias("b_part"), before.alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "part").orderBy("uid", "at")) - 1)
    ranked = ranked.join(before, (F.col("kind") == F.col("b_kind")) & (F.col("part") == F.col("b_part")))
    ranked = ranked.withColumn("r", F.col("rank") + F.col("before"))

    def run_of(runs: str, rank: str) -> Column:
        return F.element_at(F.filter(runs, lambda s: (s["lo"] <= F.col(rank)) & (F.col(rank) < s["hi"])), 1)

    item = ranked.join(F.broadcast(kinds), F.col("kind") == F.col("k_kind")).withColumn("k", run_of("k_runs", "r"))
    inside = F.col("r") - F.col("k.lo")
    item = item.withColumn("class", F.col("k.class")).withColumn("i", (F.col("k.first") + F.floor(inside / F.col("k.pieces"))).cast("long")).withColumn("nth", inside % F.col("k.pieces"))
    joined = item.join(F.broadcast(taking), F.col("class") == F.col("slot_class")).withColumn("hit", run_of("runs", "i"))
    inside = F.col("i") - F.col("hit.lo")
    placed = joined.select(
        "uid", "at", "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("hit.base") + F.floor(inside / F.col("hit.copies"))).cast("long").alias("sequence_id"),
        (F.col("hit.at") + inside % F.col("hit.copies")).alias("place"), "nth",
    )
    earlier = Window.partitionBy("sequence_id").orderBy("place", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).drop("place", "nth")
    if not with_ids:
        return placed.drop("uid", "at")
    ids = wide.select(F.col("uid").alias("of"), F.col("ids").alias("piece"))  # the ids are exchanged once, unsorted: the narrow side is hashed
    joined = ids.join(placed.hint("shuffle_hash"), F.col("of") == F.col("uid"))
    part = F.substring("piece", 4 * F.col("at") + 1, (4 * F.col("length")).cast("int"))
    return joined.select(*[c for c in placed.columns if c not in ("uid", "at")], part.alias("ids"))


def op1_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return narrow_result(pack)(documents(spark, sf_dir), tokenizer_path, with_ids=False)
