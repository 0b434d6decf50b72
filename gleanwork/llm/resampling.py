"""Importance resampling towards a target's hashed n-gram distribution.

Identical texts are collapsed first, by grouping on the full text; everything that depends on
the text is then done once per different text. Words become hash buckets of their runs
of one to three; corpus counts multiply a text's counts by its multiplicity; the
log-ratio of a bucket's share in the target and in the corpus is the bucket's gain, and a text's
weight the sum of its features' gains. Weights are joined back to the documents by the
text's SHA-256, and only there is noise added that depends on the document: the highest
of weight plus Gumbel noise are a sample without replacement by weight.

The join back broadcasts the texts that make up a thousandth of all rows or more, and shuffles
for the others. The driver sees one number per bucket.

CRC-32 is linear, so that of ``a b`` follows from those of ``a`` and ``b`` and the length of
``b``: hashes of runs come from words' hashes in NumPy, without building the runs.

Nulls and edge cases: a null or empty text has no words, weight 0, and isn't drawn; a null
doc_id adds the noise of an empty id and is last among ties; repeated rows are rows of
their own with equal scores; texts are read whole, in slices of ``SLICE`` bytes that
carry the last two words over; an empty target gives gains that only follow
the corpus; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm.common import documents, join_by_frequency, materialize, narrow_result, release_memory
from gleanwork.operators.checkpoints import numbered

BUCKETS = 10_000
#: Bytes of text handled at once.
SLICE = 1 << 22
#: Words up to so many bytes are hashed together, column of bytes by column; longer ones one by one.
SHORT_WORD = 24
#: A-Z to a-z; what stands between words to a space: ASCII but for letters and digits.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
POLYNOMIAL = 0xEDB88320


@functools.cache
def byte_step() -> np.ndarray:
    """CRC-32's table: what one byte does to the register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def stepped(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """The register after one more byte (without the inversion at either end)."""
    return byte_step()[(crc ^ np.uint32(byte) if isinstance(byte, int) else crc ^ byte) & 255] ^ (crc >> 8)


def transformed(tables: np.ndarray, at: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The linear map ``tables[at]`` of each register, byte by byte."""
    flat, base = tables.reshape(-1), at * 1024
    out = flat[base + (crc & 255)]
    for j in (1, 2, 3):
        out ^= flat[base + (256 * j) + ((crc >> (8 * j)) & 255)]
    return out


@functools.lru_cache(maxsize=4096)
def zeros(length: int) -> np.ndarray:
    """The map of ``length`` zero bytes as four tables of 256; lengths are put together from halves."""
    low = np.arange(256, dtype=np.uint32)
    values = np.stack([low << (8 * j) for j in range(4)])
    if length == 0:
        return values
    if length == 1:
        return stepped(values, 0)
    half = zeros(length // 2)
    return transformed(np.stack([zeros(length - length // 2)]), np.zeros(values.shape, dtype=np.int64), half)


def word_hashes(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each word of a buffer."""
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    alive = np.flatnonzero(lengths <= SHORT_WORD)
    order = alive[np.argsort(-lengths[alive], kind="stable")]
    sizes = lengths[order]
    reg, begin = crc[order], starts[order]
    for place in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -place, side="left"))  # words longer than place
        reg[:n] = stepped(reg[:n], buffer[begin[:n] + place])
    crc[order] = reg ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > SHORT_WORD).tolist():
        crc[i] = zlib.crc32(buffer[starts[i] : starts[i] + lengths[i]])
    return crc


def appended(crc: np.ndarray, word: np.ndarray, tables: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """CRC-32 of what ``crc`` is of, a space and a word."""
    spaced = stepped(crc ^ np.uint32(0xFFFFFFFF), 32) ^ np.uint32(0xFFFFFFFF)
    return transformed(tables, kind, spaced) ^ word


def hashed_features(parts: list[bytes], skip: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the part of every feature, and each part's words. A part's first ``skip`` words are context only."""
    joined = b" ".join([*parts, b""])
    buffer = np.frombuffer(joined, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], buffer != 32, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    first = np.cumsum([0, *(len(p) + 1 for p in parts)])
    begin = np.searchsorted(starts, first)  # each part's first word
    count = np.diff(begin)
    part = np.repeat(np.arange(len(parts)), count)
    inside = np.arange(len(starts)) - begin[:-1][part]
    one = word_hashes(buffer, starts, lengths)
    kinds, kind = np.unique(lengths, return_inverse=True)
    tables = np.stack([zeros(int(n)) for n in kinds]) if len(kinds) else np.zeros((0, 4, 256), np.uint32)
    two = appended(one[:-1], one[1:], tables, kind[1:])
    three = appended(two[:-1], one[2:], tables, kind[2:])
    real = inside >= skip[part]
    told = [(one, real), (two, (real & (inside >= 1))[1:]), (three, (real & (inside >= 2))[2:])]
    bucket = np.concatenate([(crc[keep] % np.uint32(buckets)).astype(np.int64) for crc, keep in told])
    owner = np.concatenate([part[i:][keep] for i, (_, keep) in enumerate(told)])
    return bucket, owner, count - np.minimum(skip, count)


def parts_of(text: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """A text in slices of about ``size`` bytes, cut between words, each with the two words before it, and how many those are."""
    plain, at, before = text.translate(PLAIN), 0, []
    while True:
        end = plain.find(b" ", at + size) if len(plain) - at > size else -1
        body = plain[at:end] if end >= 0 else plain[at:] if at else plain
        yield (b" ".join([*before, body]) if before else body), len(before)
        if end < 0:
            return
        before = [*before, *body.rsplit(None, 2)[-2:]][-2:]
        at = end


def sliced(rows: Iterator[tuple[tuple, bytes]], size: int) -> Iterator[tuple[list[tuple], list[bytes], np.ndarray]]:
    """Rows in groups of about ``size`` bytes: for each part the row's key, the part and its number of context words."""
    keys, parts, skips, held = [], [], [], 0
    for key, text in rows:
        for part, skip in parts_of(text, size):
            keys.append(key)
            parts.append(part)
            skips.append(skip)
            held += len(part) + 64
            if held >= size:
                yield keys, parts, np.array(skips)
                keys, parts, skips, held = [], [], [], 0
    if parts:
        yield keys, parts, np.array(skips)


def arrow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """(all columns but the last, the last), row by row."""
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        keys = zip(*(c.to_pylist() for c in columns[:-1]), strict=True)
        for key, text in zip(keys, columns[-1], strict=True):
            yield key, text.as_py() or b""


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, size: int = SLICE) -> np.ndarray:
    """How often each bucket occurs in ``texts`` (n, text), counts times n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for keys, parts, skip in sliced(arrow_rows(batches), size):
            times = np.array([n for (n,) in keys], dtype=np.float64)
            bucket, owner, _ = hashed_features(parts, skip, buckets)
            total += np.bincount(bucket, weights=times[owner], minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])
        release_memory()

    counted = texts.select(F.col("n").cast("long").alias("n"), F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    whole = len(corpus)
    top, bottom = float(corpus.sum() + whole), float(target.sum() + whole)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * top / ((float(s) + 1) * bottom))) for s, t in zip(corpus, target, strict=True)], dtype=np.int64)


WEIGHTS = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def weighed(texts: DataFrame, gain: np.ndarray, size: int = SLICE) -> DataFrame:
    """digest, n, n_words, n_features and weight of every different text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, sums = None, [0, 0, 0]  # the text whose parts may go on in the next slice
        for keys, parts, skip in sliced(arrow_rows(batches), size):
            bucket, owner, words = hashed_features(parts, skip, len(gain))
            count = np.bincount(owner, minlength=len(parts))
            order = np.argsort(owner, kind="stable")
            run = np.concatenate(([0], np.cumsum(gain[bucket[order]])))
            last = np.cumsum(count)
            weight = run[last] - run[last - count]
            rows = []
            for key, w, c, g in zip(keys, words.tolist(), count.tolist(), weight.tolist(), strict=True):
                if open_key is not None and key is not open_key:
                    rows.append((*open_key, *sums))
                    sums = [0, 0, 0]
                open_key, sums = key, [sums[0] + w, sums[1] + c, sums[2] + g]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), WEIGHTS.types, strict=True)], schema=WEIGHTS)
        if open_key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*open_key, *sums), WEIGHTS.types, strict=True)], schema=WEIGHTS)
        release_memory()

    return texts.select("digest", "n", F.col("text").cast("binary").alias("text")).mapInArrow(weigh, "digest binary, n long, n_words long, n_features long, weight long")


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def gumbel(seed: str, key: Column, factor: int = 1000) -> Column:
    """floor(factor * Gumbel noise) of a key, from the first 32 bits of its SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(factor)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


@narrow_result
def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: str = "42", buckets: int = BUCKETS, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null for those that aren't drawn.

    ``target`` holds texts of the distribution wanted. Drawn are the ``share`` of the documents with ``least_words``
    or more, those of highest score.
    """
    texts = materialize(docs.groupBy(F.coalesce(F.col("text"), F.lit("")).alias("text")).agg(F.count("*").alias("n")).withColumn("digest", text_digest(F.col("text"))))
    wanted = bucket_counts(target.select(F.lit(1).alias("n"), F.coalesce(F.col("text"), F.lit("")).alias("text")), buckets, slice_bytes)
    gain = gains(bucket_counts(texts, buckets, slice_bytes), wanted)
    weights = materialize(weighed(texts, gain, slice_bytes))
    rows, eligible = weights.agg(F.sum("n"), F.sum(F.when(F.col("n_words") >= least_words, F.col("n")))).first()
    drawn = share[0] * (eligible or 0) // share[1]
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"))
    scored = join_by_frequency(named, weights, "digest", "n", rows or 0, apart=F.col("doc_id")).drop("digest")
    scored = scored.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))).withColumn("enough", F.col("n_words") >= least_words)
    placed = numbered(scored, [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")], "place")
    rank = F.when(F.col("enough") & (F.col("place") <= drawn), F.col("place")).cast("long")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return told.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of a feature by its definition, byte by byte from a table that SQL builds too.
OP13_SQL = r"""
WITH crc_table AS MATERIALIZED (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(list_concat([b], range(0, 8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step
), texts AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS uid, text FROM documents
  UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark
), split AS MATERIALIZED (
  SELECT kind, id, uid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts
), features AS MATERIALIZED (
  SELECT kind, uid, array_to_string(w[i : i + k - 1], ' ') AS f, count(*) AS n FROM split, range(1, 4) a(k), unnest(range(1, len(w) - k + 2)) b(i) GROUP BY ALL
), hashed AS MATERIALIZED (
  SELECT f, CAST(xor(list_reduce(list_concat([4294967295], list_transform(range(0, CAST(len(hex(encode(f))) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS INTEGER) AS bucket
  FROM (SELECT DISTINCT f FROM features), crc_table
), counted AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t FROM features JOIN hashed USING (f) GROUP BY bucket
), sums AS (
  SELECT *, sum(s) OVER () AS ss, sum(t) OVER () AS tt FROM counted
), gained AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(ss AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(tt AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM sums
), weighed AS (
  SELECT uid, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM features JOIN hashed USING (f) JOIN gained USING (bucket) WHERE kind = 'd' GROUP BY uid
), scored AS (
  SELECT id AS doc_id, len(w) >= 20 AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN weighed USING (uid) WHERE kind = 'd'
), placed AS (
  SELECT *, row_number() OVER (ORDER BY enough DESC, score DESC, doc_id NULLS LAST, weight DESC, n_features DESC) AS place, 5 * count(*) FILTER (enough) OVER () // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= drawn THEN place END AS rank FROM placed
"""
