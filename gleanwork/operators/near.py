"""Overlap joins of token sets, cell by cell.

Rows of both sides are dealt into blocks by a hash of their id, and each pair of blocks is a cell. So no task gets all rows
of a frequent token, candidates are never written or shuffled, and what moves is each row once for each block of the other
side. There are as many cells as keep the cores busy, however many rows there are, so what moves grows as the rows do, until
a block of the right side would hold more than ``HELD`` tokens. A task indexes its block by token, some rows at a time, and
streams the left rows past: memory is bounded by the block, however many pairs there are. Comparing costs rows times rows, at
a few nanoseconds each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

#: Tokens of a right side's block at most, and rows of one index over a part of it.
HELD, BLOCK = 1 << 23, 32_768
#: Tables are cut into so many cells at least, for the sake of all cores, but not below so many rows.
LEAST_CELLS, FEW = 24, 256
#: Pairs of one batch of a result.
BATCH = 200_000


class Index:
    """Some rows of a block of the right side by token."""

    def __init__(self, rows: pa.Table, threshold: float) -> None:
        tokens = rows["tokens"].combine_chunks()
        coded = tokens.flatten().dictionary_encode()
        self.words, codes = coded.dictionary, coded.indices.to_numpy()
        self.sizes = pc.list_value_length(tokens).to_numpy().astype(np.int64)
        self.rows = np.repeat(np.arange(len(self.sizes)), self.sizes)[np.argsort(codes, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.words)))])
        self.threshold, self.needs = threshold, {}
        self.ids = rows["id"].combine_chunks()
        self.order = self.ids.to_numpy(zero_copy_only=False)
        self.at = rows["at"].to_numpy()
        self.groups, self.names = pd.factorize(rows["label"].to_pandas())

    def need(self, n: int) -> np.ndarray:
        """The fewest shared tokens with each row that make the overlap with a set of n large enough."""
        if n not in self.needs:
            sizes, back = np.unique(np.minimum(n, self.sizes), return_inverse=True)
            self.needs[n] = np.array([next((c for c in range(k + 1) if c / k >= self.threshold), k + 1) for k in sizes.tolist()], np.int32)[back]
        return self.needs[n]

    def near(self, left: pa.Table, done: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each left row that isn't done its place, the rows that it is near to, and the scores."""
        tokens = left["tokens"].combine_chunks()
        codes = pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.words), -1).to_numpy()
        sizes = pc.list_value_length(tokens).to_numpy()
        ends = np.cumsum(sizes)
        for i, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
            if done[i]:
                continue
            own = [self.rows[self.starts[c] : self.starts[c + 1]] for c in codes[end - n : end].tolist() if c >= 0]
            if own:
                shared = np.bincount(np.concatenate(own), minlength=len(self.sizes))
                hits = np.flatnonzero(shared >= self.need(n))
                if len(hits):
                    yield i, hits, shared[hits] / np.minimum(n, self.sizes[hits])


def _compared(threshold: float, schema: pa.Schema, blocks: int, within: bool, earlier: bool, horizon: int | None, room: int | None) -> Callable:
    """The function of a task over rows sorted by cell, the right side's first."""
    only_found = "score" not in schema.names

    def picked(index: Index, hits: np.ndarray, score: np.ndarray, held: list) -> np.ndarray:
        """Those of the hits that can be among the first ``room``: the best of each label that isn't held, then the others."""
        best = np.lexsort((index.order[hits], -score))
        label = index.groups[hits][best]
        names = index.names[label]
        first = np.zeros(len(best), bool)
        first[np.unique(label, return_index=True)[1]] = True
        first &= (label < 0) | ~np.isin(names, held)
        return best[np.concatenate([np.flatnonzero(first)[:room], np.flatnonzero(~first)[:room]])]

    def results(index: Index, left: pa.Table, cell: int, done: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = left["id"].combine_chunks()
        order, at, below = ids.to_numpy(zero_copy_only=False), left["at"].to_numpy(), left["below"].to_numpy()
        held = left["held"].to_pylist() if room is not None else None
        mine, theirs, scores, n = [], [], [], 0

        def out() -> pa.RecordBatch:
            a = ids.take(pa.array(np.concatenate(mine)))
            if only_found:
                return pa.RecordBatch.from_arrays([a.cast(schema.field(0).type)], schema=schema)
            return pa.RecordBatch.from_arrays([a, index.ids.take(pa.array(np.concatenate(theirs))), pa.array(np.concatenate(scores))], schema=schema)

        for i, hits, score in index.near(left, done):
            ok = np.ones(len(hits), bool)
            if within and cell // blocks == cell % blocks:
                ok &= index.order[hits] > order[i]
            if earlier:
                ok &= index.order[hits] < order[i]
            if horizon is not None:
                ok &= at[i] - index.at[hits] <= horizon
            if not np.isnan(below[i]):
                ok &= score < below[i]
            if not ok.any():
                continue
            if only_found:
                mine.append(np.array([i]))
                done[i] = True
                n += 1
            else:
                hits, score = hits[ok], score[ok]
                if room is not None:
                    keep = picked(index, hits, score, held[i] or [])
                    hits, score = hits[keep], score[keep]
                mine.append(np.full(len(hits), i))
                theirs.append(hits)
                scores.append(score)
                n += len(hits)
            if n >= BATCH:
                yield out()
                mine, theirs, scores, n = [], [], [], 0
        if mine:
            yield out()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, right, indexes, n = None, [], [], 0
        for batch in batches:
            cells, sides = batch["cell"].to_numpy(), batch["side"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1).tolist(), len(cells)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                if cells[begin] != at:
                    at, right, indexes, n = cells[begin], [], [], 0
                part = pa.Table.from_batches([batch.slice(begin, end - begin)])
                if sides[begin] == 0:
                    right.append(part)
                    n += len(part)
                if right and (sides[begin] == 1 or n >= BLOCK):
                    indexes.append(Index(pa.concat_tables(right), threshold))
                    right, n = [], 0
                if sides[begin] == 1:
                    done = np.zeros(len(part), bool)
                    for index in indexes:
                        yield from results(index, part, int(at), done)

    return task


def _dealt(rows: DataFrame, side: int, cells: Column) -> DataFrame:
    """Rows (id, tokens and what there is of at, below, held and label) once for each of their cells."""
    none = {"at": "long", "below": "double", "held": "array<string>", "label": "string"}
    given = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in none.items()]
    return rows.where(F.size("tokens") > 0).select(F.explode(cells).alias("cell"), F.lit(side).alias("side"), "id", "tokens", *given)


def _grid(left: int, right: int, tokens: int, cells: int, within: bool) -> tuple[int, int]:
    """Blocks of the left and of the right side, of so many rows, the right with so many tokens: as many as fill the cells, and of those the split that moves the fewest rows."""
    least, most_down, most_across = -(-tokens // HELD) or 1, -(-left // FEW) or 1, -(-right // FEW) or 1
    if within:  # half of the grid is used
        n = max(least, min(math.isqrt(2 * cells), most_across))
        return n, n
    splits = [(min(most_down, -(-cells // across)), across) for across in range(least, max(least, min(cells, most_across)) + 1)]
    return min(splits, key=lambda s: (-min(s[0] * s[1], cells), left * s[1] + right * s[0]))


def _joined(left: DataFrame, right: DataFrame, threshold: float, result: str, within: bool = False, earlier: bool = False, horizon: int | None = None, room: int | None = None) -> DataFrame:
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    held = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens")).first()
    cells = max(LEAST_CELLS, 2 * left.sparkSession.sparkContext.defaultParallelism)
    down, across = _grid(held["n"] if within else left.count(), held["n"], held["tokens"], cells, within)
    if within:
        of_left = F.transform(F.sequence(block(down), F.lit(down - 1)), lambda j: block(down) * down + j)
        of_right = F.transform(F.sequence(F.lit(0), block(down)), lambda i: i * down + block(down))
    else:
        of_left = F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda j: block(down) * across + j)
        of_right = F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda i: i * across + block(across))
    both = _dealt(right, 0, of_right).unionByName(_dealt(left, 1, of_left))
    sorted_ = both.repartitionById(down * across, "cell").sortWithinPartitions("cell", "side")
    kind = {"a": left.schema["id"].dataType, "b": right.schema["id"].dataType}
    schema = StructType()
    for name in result.split():
        schema.add(name, kind.get(name, DoubleType()))
    return sorted_.mapInArrow(_compared(threshold, to_arrow_schema(schema), across, within, earlier, horizon, room), schema)


def pairs(left: DataFrame, right: DataFrame, threshold: float, room: int | None = None) -> DataFrame:
    """(a, b, score) of rows (id, tokens) with overlap of at least ``threshold``; ids must not repeat, and both sides are read several times.

    ``below`` of a left row, where it has one, is what its scores stay under. With ``room``, a left row keeps a few candidates of each
    cell only, among them all that are in its first ``room`` when the best of each label of the right side, but those
    that it has in ``held``, come before all others; ties go to the smaller id.
    """
    return _joined(left, right, threshold, "a b score", room=room)


def within(sets: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` of rows with themselves, each pair once, as a < b."""
    return _joined(sets, sets, threshold, "a b score", within=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def found(left: DataFrame, right: DataFrame, threshold: float, earlier: bool = False, horizon: int | None = None) -> DataFrame:
    """(a): the left ids that overlap a right row enough, perhaps only one of a smaller id, or at most ``horizon`` before it by ``at``."""
    return _joined(left, right, threshold, "a", earlier=earlier, horizon=horizon).distinct()
