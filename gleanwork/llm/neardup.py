"""MinHash near-duplicates with odd sketches.

Each document's set of word shingles is MinHashed; bands of the MinHash propose
candidates, and the MinHash values fold into a parity bitmap, the odd sketch, whose
XOR population count estimates high similarities precisely. Candidates that the
sketches leave over are confirmed by intersecting the full shingle sets.

Groups of any size stay close to linear in rows. Equal sets are one class, found by a hash
aggregate. In each bucket of a band, members are compared by sketch with one centre
per bucket and similar ones take the smallest such centre as their family; then only members
outside the family of their bucket's centre are compared with the bucket's other members, over a grid
of blocks where a bucket is large, so what is emitted is pairs of different families that
the sketches find similar, and those families merge too. Every pair of one bucket that may
reach the threshold is then in one family. Within a family, tasks of bounded bytes
intersect full sets and return the links that connect its documents, never all pairs. A
family too large for one task is split into blocks, each with the family's first document;
only documents that this leaves unconnected to it are compared with the other blocks. Nothing
is capped. What can be lost is a link that no band proposes or whose sketches differ by
chance beyond five sigma: about 1 in 100,000 at the threshold of 85 percent with 32 bands,
and with as many bands as ``bands_for`` gives for another threshold, less above.

Nulls and edge cases: documents without words, or with null text, have an empty set
and are linked with nothing; with fewer words than a shingle has, the whole sequence is
one shingle; rows without doc_id are in no component (component_id null, kept); rows
that repeat a doc_id are one document whose links are those of all its texts; texts of
any length are read whole, in pieces of bounded size; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm.common import documents, materialize, narrow_result, release_memory, small_batches

PIECE = 1 << 20
MEMO = 200_000
SKETCH_BITS = 1024
SPACE = b" \t\n\r\x0b\x0c"
#: Rows up to which ids and their families are broadcast to the scan of the texts (16 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 500_000
STAR_TURNS = 2
#: Documents of one family, and shingles of theirs, that a task intersects at once; members of a bucket that it compares with as many.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 7

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def sketch_limit(self) -> int:
        """Differing sketch bits up to which a pair may reach the threshold: five sigma of sampling and folding together."""
        t, n, b = self.percent / 100, self.hashes, SKETCH_BITS
        flips, spread = 2 * n * (1 - t), 2 * math.sqrt(n * t * (1 - t))
        mean = b / 2 * (1 - math.exp(-2 * flips / b))
        sampling, folding = spread * math.exp(-2 * flips / b), math.sqrt(b / 4 * (1 - math.exp(-4 * flips / b)))
        return math.ceil(mean + 5 * math.hypot(sampling, folding))


def bands_for(percent: int, rows: int = 7, miss: float = 1e-5) -> int:
    """The bands with which at most ``miss`` of the pairs at the threshold share none."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Texts to sets of 64-bit shingle hashes, MinHash bands and odd sketches."""

    def __init__(self, how: Settings) -> None:
        self.how, self.hashes = how, _WordHashes()
        draw = np.random.default_rng(20240)
        self.word_odd = draw.integers(1, 1 << 63, size=max(8, how.words), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.a = (draw.integers(0, 1 << 31, size=how.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = draw.integers(0, 1 << 32, size=how.hashes, dtype=np.uint32)[:, None]
        self.band_odd = draw.integers(1, 1 << 63, size=(how.bands, how.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band_salt = _mix(np.arange(1, how.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.sample_salt = _mix(np.arange(1, how.hashes + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def word_hashes(self, text: str | None) -> np.ndarray:
        raw, out, at = (text or "").encode("utf-8", "replace").lower(), [], 0  # bytes.lower touches A-Z only
        while at < len(raw):
            end = at + PIECE
            while end < len(raw) and raw[end] not in SPACE:
                end += 1
            words = raw[at:end].split()
            out.append(np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        w, k = self.word_hashes(text), self.how.words
        if not len(w):
            return w
        n = max(1, len(w) - k + 1)
        h = np.full(n, min(len(w), k), dtype=np.uint64)
        for i in range(min(k, len(w))):
            h += _mix(w[i : i + n]) * self.word_odd[i]
        return np.unique(_mix(h))

    def min_hashes(self, shingles: np.ndarray) -> np.ndarray:
        low, x = np.full(self.how.hashes, 0xFFFFFFFF, dtype=np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 512):
            low = np.minimum(low, (self.a * x[None, at : at + 512] + self.b).min(axis=1))
        return low

    def bands(self, low: np.ndarray) -> np.ndarray:
        rows = _mix(low.astype(np.uint64)).reshape(self.how.bands, self.how.rows)
        return _mix((rows * self.band_odd).sum(axis=1, dtype=np.uint64) ^ self.band_salt).view(np.int64)

    def sketch(self, low: np.ndarray) -> np.ndarray:
        at = _mix(low.astype(np.uint64) ^ self.sample_salt) >> np.uint64(64 - 10)
        odd = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
        return np.packbits(odd).view(np.int64)


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, how: Settings) -> DataFrame:
    """Each row's set size, a 128-bit hash of its set, its bands and its odd sketch."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Shingler(how)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = s.shingles(text)
                both = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype=np.int64)
                low = s.min_hashes(found) if len(found) else None
                out.append((doc_id, len(found), both[0], both[1], None if low is None else s.bands(low), None if low is None else s.sketch(low)))
            frame = pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])
            yield frame.astype({"doc_id": "Int64"})
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(sign, SIGNED)


def shingle_sets(docs: DataFrame, how: Settings) -> DataFrame:
    """docs with ``set`` in place of ``text``."""

    @F.pandas_udf("array<long>")
    def sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Shingler(how)
        for batch in texts:
            yield pd.Series([s.shingles(t).view(np.int64) for t in batch])
        release_memory()

    return docs.select(*[c for c in docs.columns if c != "text"], sets("text").alias("set"))


def cell_roots(ids: list[int], side: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Each document with the smallest one that it is connected to in this cell; with two sides only documents of different sides are compared."""
    order = np.argsort(np.array(ids), kind="stable")
    ids, side = [ids[i] for i in order], np.array(side)[order]
    sizes = np.array([len(sets[i]) for i in order])
    distinct, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark, label = np.zeros(len(distinct), dtype=bool), np.arange(len(ids))
    two_sided = side.any() and not side.all()
    for i in range(len(ids)):
        other = label != label[i]
        if two_sided:
            other &= side != side[i]
        if not other.any():
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        inter = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[own] = False
        for j in np.flatnonzero(other & (inter * 100 >= (sizes + sizes[i] - inter) * percent)):
            if label[j] != label[i]:
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return [(i, ids[x]) for i, x in zip(ids, label, strict=True)]


def roots_of_cells(placed: DataFrame, percent: int) -> DataFrame:
    """family, id, root: ``cell_roots`` of each cell (family, x, y) of the rows (family, x, y, id, side, set)."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, side, sets = None, [], [], []

        def found() -> list[tuple[int, int, int]]:
            return [(key[0], i, r) for i, r in cell_roots(ids, side, sets, percent)] if len(ids) > 1 else [(key[0], ids[0], ids[0])] if ids else []

        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for f, x, y, i, s, v in zip(batch["family"], batch["x"], batch["y"], batch["id"], batch["side"], batch["set"], strict=True):
                if (f, x, y) != key:
                    out.extend(found())
                    key, ids, side, sets = (f, x, y), [], [], []
                ids.append(i)
                side.append(s)
                sets.append(np.array(v))
            yield pd.DataFrame(out, columns=["family", "id", "root"], dtype="int64")
        yield pd.DataFrame(found(), columns=["family", "id", "root"], dtype="int64")
        sets.clear()
        release_memory()

    cells = placed.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "id")
    return cells.mapInPandas(link, "family long, id long, root long")


def few(narrow: DataFrame) -> DataFrame:
    """A narrow table, to be broadcast if it has at most ``BROADCAST_ROWS``; else the join shuffles."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow


def family_links(docs: DataFrame, families: DataFrame, how: Settings) -> DataFrame:
    """Links (a, b) by full sets within families (id, family, n_shingles): enough of them to connect all that is linked."""
    sizes = families.groupBy(F.col("family").alias("f")).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = materialize(sizes.select("f", blocks.alias("blocks")))
    member = materialize(families.join(sizes, F.col("family") == F.col("f")).select("id", "family", "blocks"))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few(member), F.col("doc_id") == F.col("id"))
    texts = texts.select("id", "family", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"), "text")
    sets = materialize(shingle_sets(texts, how))
    # a family's id is its first document's; that one is in each of its blocks
    every, zero = F.sequence(F.lit(0), F.col("blocks") - 1), F.lit(0)
    placed = sets.withColumn("x", F.explode(F.when(F.col("id") == F.col("family"), every).otherwise(F.array("own"))))
    roots = materialize(roots_of_cells(placed.select("family", "x", zero.alias("y"), "id", zero.alias("side"), "set"), how.percent))
    links = roots.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    large = sets.where("blocks > 1")
    left = materialize(roots.where("root <> family").select(F.col("id").alias("left_id"), F.col("family").alias("lf")).join(few(sizes.where("blocks > 1")), F.col("lf") == F.col("f"), "left_semi").distinct())
    if left.isEmpty():
        return links.distinct()
    # those meet all blocks of their family, in blocks of their own
    theirs = large.join(few(left.select("left_id")), F.col("id") == F.col("left_id"), "left_semi").select("family", F.col("own").alias("x"), F.explode(every).alias("y"), "id", F.lit(1).alias("side"), "set")
    open_ = materialize(left.select("lf").distinct())
    others = large.join(few(open_), F.col("family") == F.col("lf"), "left_semi").select("family", F.explode(every).alias("x"), F.col("own").alias("y"), "id", zero.alias("side"), "set")
    more = roots_of_cells(theirs.unionByName(others), how.percent).where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    return links.unionByName(more).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component for every id with an edge (a, b): the smallest id reachable.

    Large-star and small-star steps in turn. Each needs a min per node, which is combined before
    it is exchanged and broadcast back while it is small; every step is written out.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m")))
        large = materialize(both.where("v > u").join(few(low), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = materialize(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")))
        pointed = large.join(few(low), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(pointed.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        parents = materialize(edges.select(F.col("v").alias("p")).distinct())
        if edges.join(few(parents), F.col("u") == F.col("p"), "left_semi").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(parents.select("p", "p"))


def labelled(families: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """id, family after the pairs (a, b) joined: of each a, the smallest family among its own and its partners'. Ids without a row are their own."""
    reached = pairs.select(F.col("a").alias("id"), F.col("b").alias("family"))
    if families is not None:
        known = families.withColumnsRenamed({"id": "kid", "family": "kf"})
        told = pairs.join(few(materialize(known)), F.col("b") == F.col("kid"), "left").select(F.col("a").alias("id"), F.coalesce("kf", "b").alias("family"))
        reached = families.union(told)
    return reached.groupBy("id").agg(F.min("family").alias("family")).select("id", F.least("id", "family").alias("family"))


def _differing(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def similar_pairs(pairs: DataFrame, sketches: DataFrame, limit: int) -> DataFrame:
    """The distinct pairs (a, b) whose odd sketches differ in at most ``limit`` bits; many may share their b."""
    pairs = materialize(pairs.distinct())
    one = sketches.select(F.col("id").alias("ia"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("id").alias("ib"), F.col("sketch").alias("sb"))
    centres_ = materialize(two.join(few(pairs.select(F.col("b").alias("named")).distinct()), F.col("ib") == F.col("named"), "left_semi"))
    small = centres_.count() <= BROADCAST_ROWS // 16  # a sketch is 128 bytes
    both = pairs.join(one, F.col("a") == F.col("ia")).join(F.broadcast(centres_) if small else centres_, F.col("b") == F.col("ib"))
    return both.where(_differing("sa", "sb") <= limit).select("a", "b")


def placed_in(rows: DataFrame, families: DataFrame | None) -> DataFrame:
    """The rows (bucket, id) with their family; an id without one is its own."""
    if families is None:
        return rows.withColumn("family", F.col("id"))
    known = families.withColumnsRenamed({"id": "kid", "family": "kf"})
    return rows.join(known, F.col("id") == F.col("kid"), "left").select("bucket", "id", F.coalesce("kf", "id").alias("family"))


def centres(placed: DataFrame, turn: int) -> DataFrame:
    """Buckets of several families: cb, n, centre and its family; each turn has other centres. Aggregates combine before they are exchanged."""
    order = F.col("id") if turn == 0 else F.xxhash64("id", "bucket", F.lit(turn))
    told = placed.groupBy(F.col("bucket").alias("cb")).agg(
        F.count("*").alias("n"), F.min("family").alias("lo"), F.max("family").alias("hi"),
        F.min(F.struct(order.alias("o"), F.col("id").alias("centre"), F.col("family").alias("cf"))).alias("c"),
    )
    return materialize(told.where("lo <> hi").select("cb", "n", "c.centre", "c.cf"))


def similar_families(classes: DataFrame, placed: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) of families that share a bucket and hold members whose sketches are similar, of which one is outside of the centre's family.

    A bucket is dealt over a grid of blocks of its outsiders and its members.
    """
    told = centres(placed, STAR_TURNS)
    inside = materialize(placed.join(few(told), F.col("bucket") == F.col("cb")).select("bucket", "id", "family", "cf", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    sketch = classes.select(F.col("id").alias("kid"), F.col("sketch").alias("s"))
    inside = inside.join(sketch, F.col("id") == F.col("kid")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    apart = inside.where("family <> cf").select(F.col("bucket").alias("ob"), F.col("own").alias("ox"), every.alias("oy"), F.col("family").alias("of"), F.col("s").alias("sa"))
    rest = inside.select("bucket", every.alias("x"), F.col("own").alias("y"), F.col("family").alias("mf"), F.col("s").alias("sb"))
    same = (F.col("ob") == F.col("bucket")) & (F.col("ox") == F.col("x")) & (F.col("oy") == F.col("y"))
    across = apart.join(rest, same & (F.col("of") != F.col("mf")) & (_differing("sa", "sb") <= limit))
    # families already name what their members share: one edge for each pair of them is enough
    return across.select(F.col("of").alias("a"), F.col("mf").alias("b")).distinct()


def sketch_families(classes: DataFrame, how: Settings) -> DataFrame:
    """id, family: two classes (id, bands, sketch) that share a bucket and may be linked are in one family, named by its smallest id."""
    limit = how.sketch_limit()
    rows = classes.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy(F.col("bucket").alias("shared")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("shared")
    member = materialize(rows.join(few(materialize(shared)), F.col("bucket") == F.col("shared")).select("bucket", "id"))
    sketches = classes.select("id", "sketch")
    edges, families = None, None
    for turn in range(STAR_TURNS):
        placed = placed_in(member, families)
        apart = placed.join(few(centres(placed, turn)), F.col("bucket") == F.col("cb")).where("family <> cf")
        pairs = materialize(similar_pairs(apart.select(F.col("id").alias("a"), F.col("centre").alias("b")), sketches, limit))
        edges = pairs if edges is None else edges.union(pairs)
        families = materialize(labelled(families, pairs))
    merged = materialize(edges.union(similar_families(classes, placed_in(member, families), limit)))
    return components(merged).withColumnRenamed("component", "family")


def near_duplicates(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, how)


@narrow_result
def _near_duplicates(docs: DataFrame, how: Settings) -> DataFrame:
    signed = materialize(signatures(docs, how))
    full = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = materialize(full.groupBy(F.col("set_a").alias("ca"), F.col("set_b").alias("cb")).agg(F.min("doc_id").alias("id")))
    same = (F.col("set_a") == F.col("ca")) & (F.col("set_b") == F.col("cb"))
    first = full.join(classes.select("id", "ca", "cb"), same & (F.col("doc_id") == F.col("id"))).select("id", "n_shingles", "bands", "sketch").dropDuplicates(["id", "bands"])
    first = materialize(first)
    # ids on several rows with different texts link their sets
    twice = materialize(full.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("twice")))
    named = full.join(twice, F.col("doc_id") == F.col("twice"), "left_semi").select("doc_id", "set_a", "set_b").join(classes.select("id", "ca", "cb"), same)
    by_name = named.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    families = sketch_families(first, how).join(first.select(F.col("id").alias("fid"), "n_shingles").distinct(), F.col("id") == F.col("fid")).select("id", "family", "n_shingles")
    links = family_links(docs, materialize(families), how).union(by_name)
    comp = components(links).withColumnRenamed("id", "cid")
    member = materialize(classes.join(comp, F.col("id") == F.col("cid"), "left").select("ca", "cb", F.coalesce("component", "id").alias("component")))
    has = F.col("n_shingles") > 0
    out = signed.select("doc_id", "n_shingles", F.when(has, F.col("set_a")).alias("set_a"), F.when(has, F.col("set_b")).alias("set_b"))
    out = out.join(member, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), Settings(words=3, percent=85))
