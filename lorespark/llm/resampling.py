"""Target-distribution importance resampling, with counts by external sort.

1. Each document's features (runs of words) become 16-bit bucket numbers.
   Blocks of documents are written as one packed uint16 stream with the number
   of features of each, so that texts are read and hashed once.
2. The streams of the corpus and of the target are sorted in chunks of bounded
   size and run-length encoded; a task adds its runs up, and Spark merges the
   runs of all tasks by bucket.
3. A bucket's gain is the log of its (smoothed) share in the target over that
   in the corpus. There are as many gains as buckets, 65,536 at most whatever
   the corpus, so they go to all tasks.
4. Gains are gathered over the streams and added up from offset to offset
   (np.add.reduceat): the documents' weights.
5. A hashed Gumbel number is added to each weight. The documents are sorted by
   range, which numbers them in the order of the draw: the highest are a draw
   without replacement in proportion to their likelihood ratio.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, documents, sized

BUCKETS, MAX_RUN, SEED = 10_000, 1, 2024
#: Documents need so many words to be drawn, and this share of them, in per cent, is drawn.
MIN_WORDS, PERCENT = 20, 10
#: Features of a block, and of a chunk that is sorted at once.
BLOCK = 1 << 20
#: Words whose checksums a task remembers.
CACHE = 500_000

#: Bytes to fold and split by: A-Z become a-z, what is below 128 and neither a digit nor a letter parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

PACKED = "ids array<bigint>, words array<int>, sizes array<int>, stream binary"


class Checksums(dict):
    """Word (bytes) -> CRC-32 of it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = crc = zlib.crc32(word)
        return crc


def bucket_stream(words: list[bytes], known: Checksums, buckets: int, max_run: int) -> np.ndarray:
    """Buckets of all runs of 1 to max_run consecutive words, joined by a space."""
    part = list(map(known.__getitem__, words))
    streams = [np.fromiter(part, np.uint32, len(part))]
    for size in range(2, max_run + 1):
        # The checksum of a run goes on from that of the run without its last word.
        part = [zlib.crc32(b" " + w, crc) for crc, w in zip(part, words[size - 1 :], strict=False)]
        streams.append(np.fromiter(part, np.uint32, len(part)))
    return (np.concatenate(streams) % np.uint32(buckets)).astype("<u2")


def packed(docs: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """Blocks of documents: ids, numbers of words and of features, and all features' buckets as a uint16 stream."""
    if not 0 < buckets <= 1 << 16 or max_run < 1:
        raise ValueError("buckets must fit 16 bits")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, words, sizes, streams, held = Checksums(), [], [], [], [], 0

        def block() -> pa.RecordBatch:
            row = {"ids": (ids, pa.int64()), "words": (words, pa.int32()), "sizes": (sizes, pa.int32())}
            return pa.record_batch({c: pa.array([x], pa.list_(kind)) for c, (x, kind) in row.items()} | {"stream": pa.array([np.concatenate(streams).tobytes()], pa.binary())})

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    split = text.translate(_FOLD).split()
                    stream = bucket_stream(split, known, buckets, max_run)
                    ids.append(doc_id)
                    words.append(len(split))
                    sizes.append(len(stream))
                    streams.append(stream)
                    held += len(stream) + 16
                    if held >= BLOCK:
                        yield block()
                        ids, words, sizes, streams, held = [], [], [], [], 0
        if ids:
            yield block()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(walk, PACKED)


def bucket_counts(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of all blocks, for buckets that occur."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch["stream"]:
                features = np.frombuffer(stream.as_buffer(), "<u2")
                for begin in range(0, len(features), BLOCK):
                    chunk = np.sort(features[begin : begin + BLOCK])
                    starts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
                    total[chunk[starts]] += np.diff(np.append(starts, len(chunk)))
        seen = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(seen.astype(np.int64)), "n": pa.array(total[seen])})

    return blocks.select("stream").mapInArrow(walk, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of every bucket.

    corpus, target: (bucket, n); s and t are their counts of a bucket, S and T of all.
    """
    total = lambda side: side.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    all_s, all_t = total(corpus), total(target)
    both = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = both.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    plus = lambda c: (F.coalesce(c, F.lit(0)) + 1).cast("double")
    ratio = plus("t") * F.lit(float(all_s + buckets)) / (plus("s") * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(blocks: DataFrame, gain: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of the documents of the blocks."""
    # A gain for each bucket: a list whose length is a parameter, 65,536 at most.
    table = np.array([r["gain"] for r in gain.orderBy("bucket").collect()], np.int64)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sizes = batch["sizes"][k].values.to_numpy().astype(np.int64)
                each = table[np.frombuffer(batch["stream"][k].as_buffer(), "<u2")]
                weight, full = np.zeros(len(sizes), np.int64), sizes > 0
                if full.any():
                    weight[full] = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[full])
                yield pa.record_batch({"doc_id": batch["ids"][k].values, "n_words": batch["words"][k].values.cast(pa.int64()), "n_features": pa.array(sizes), "weight": pa.array(weight)})

    return blocks.mapInArrow(walk, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number of the doc_id in thousandths, rounded down; a null doc_id counts as no text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored with rank: 1, 2, 3 ... by score, then doc_id, for the share of the documents with enough words that is drawn.

    Rows are dealt out by ranges of their order, so each place is its place
    within its range plus the rows of the ranges before, of which there are as
    many as partitions. No task holds more than its range.
    """
    enough = F.col("n_words") >= min_words
    order = [F.col("short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("spread")]
    keyed = scored.withColumns({"short": ~enough, "spread": F.xxhash64("doc_id", F.monotonically_increasing_id())})
    keyed = scratch.write(keyed, "keyed")
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = scratch.write(dealt.withColumn("place", F.monotonically_increasing_id()).drop("spread"), "dealt")
    # monotonically_increasing_id holds the partition above, the row in it below the 33rd bit.
    part = dealt.withColumns({"part": F.shiftright("place", 33), "row": F.col("place").bitwiseAND((1 << 33) - 1)})
    sizes = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("short")).alias("long"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = scratch.write(sizes.select("part", before.alias("before"), F.floor(F.sum("long").over(Window.partitionBy()) * percent / 100).alias("drawn")), "ahead")
    placed = part.join(sized(ahead), "part")
    rank = F.col("before") + F.col("row") + 1
    return placed.withColumn("rank", F.when(~F.col("short") & (rank <= F.col("drawn")), rank)).select(*scored.columns, "rank")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_run: int = MAX_RUN, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null where it is not drawn).

    docs and target: doc_id, text. Words are those of the whole text, A-Z in
    lower case, of digits, letters and all that is not ASCII. Features are all
    runs of 1 to max_run words, repeats counted. percent of the documents with
    at least min_words words are drawn, rounded down: those with the highest
    score, ties to the smaller doc_id. A null or empty text has no feature and
    weight 0; a null doc_id comes last in ties and shares its noise with other
    null ones; rows that repeat are scored and drawn one by one; texts of any
    length go whole; other columns are not looked at, whatever their names.
    Empty docs give an empty result; an empty target leaves gains that favour
    what is rare in docs.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    blocks = scratch.write(packed(docs, buckets, max_run), "streams")
    aims = scratch.write(packed(target, buckets, max_run), "target")
    counted = [scratch.write(bucket_counts(b, buckets), name) for b, name in ((blocks, "counts"), (aims, "target_counts"))]
    scored = weighed(blocks, gains(*counted, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(scored, scratch, min_words, percent)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    aims = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    return importance_resample(documents(spark, sf_dir), aims).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of each distinct word, by its table of 256 remainders.
OP12_SQL = rf"""
WITH rem AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT range::BIGINT AS i FROM range(256))),
w AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
c AS (SELECT side, id, w, count(*) AS n FROM w GROUP BY ALL),
b AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode(w))), 2), lambda i: ('0x' || hex(encode(w))[i:i + 1])::BIGINT)),
                            lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8)), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT w FROM c), rem),
f AS (SELECT side, id, bucket, sum(n) AS n FROM c JOIN b ON c.w = b.w GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM f),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (WHERE side = 'b'), 0) + 1)::DOUBLE * (any_value(totals.s) + {BUCKETS})
                                 / ((coalesce(sum(n) FILTER (WHERE side = 'd'), 0) + 1)::DOUBLE * (any_value(totals.t) + {BUCKETS}))))::BIGINT AS gain
  FROM f, totals GROUP BY bucket),
wt AS (SELECT id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight FROM f JOIN g ON f.bucket = g.bucket WHERE side = 'd' GROUP BY id),
sc AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN wt ON doc_id = id),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= {MIN_WORDS}) AS all_ FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND place <= {PERCENT} * all_ // 100 THEN place END AS rank
FROM r
"""
