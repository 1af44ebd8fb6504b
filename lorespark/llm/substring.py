"""Substring dedup by level-wise doubling.

Level 25: of the 26 runs of 25 words in each run of 50, the one with the
smallest hash stands for it (the same one wherever those 50 words occur), and
only these are gathered. Level 50: runs of 50 whose run of 25 also occurs in
another document are hashed and gathered. From there on a run is doubled where
it and the run behind it both occur elsewhere, its hash made of theirs, until
no candidate survives. Level 50 decides what is removed; the later levels tell
how long the repeated passages are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import NO_ID, Scratch, attach, documents, fits
from lorespark.llm.hashing import WordHashes, digest, runs

WINDOW = 50


def _seeds(hashed: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` words, the smallest hash of the runs of half as many words in it."""
    half = window // 2
    low, size = runs(hashed, half), 1
    span = window - half + 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(low) - (span - size)], low[span - size :]) if span > size else low


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("oid"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _prepare(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, oid, digest of the words (d1, d2), n_words, all_sha256, seeds of documents."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part, rows = batch.slice(begin, 256), []
                for text in part["text"].to_pylist():
                    words = text.split()
                    joined = b" ".join(words)
                    seeds = np.unique(_seeds(hashes.of(words), window)).view(np.int64) if len(words) >= window else None
                    rows.append((*digest(joined), len(words), hashlib.sha256(joined).hexdigest(), seeds))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
                yield pa.record_batch({"doc_id": part["doc_id"], "oid": part["oid"]} | {k: pa.array(c, t) for k, c, t in zip(["d1", "d2", "n_words", "all_sha256", "seeds"], cols, types, strict=True)})

    return _texts(docs).mapInArrow(walk, "doc_id bigint, oid bigint, d1 bigint, d2 bigint, n_words bigint, all_sha256 string, seeds array<bigint>")


def _of(docs: DataFrame, told: DataFrame) -> DataFrame:
    """Texts of the documents of another table, with its columns (unique oid)."""
    texts = _texts(docs).select("oid", "text")
    ids = told.select("oid")
    if fits(ids):
        texts = texts.join(F.broadcast(ids), "oid", "left_semi")
    return texts.join(told, "oid")


def _windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(w1, w2, oid, d1, pos) of every run of ``window`` words whose seed is among the document's wanted ones."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for oid, text, seeds in zip(batch["oid"].to_pylist(), batch["text"].to_pylist(), batch["seeds"], strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                hashed = hashes.of(words)
                at = np.flatnonzero(np.isin(_seeds(hashed, window), seeds.values.to_numpy().view(np.uint64)))
                d1 = digest(b" ".join(words))[0]
                lanes = [runs(hashed, window, k)[at].view(np.int64) for k in (0, 1)]
                for i in range(0, len(at), 50_000):
                    n = len(at[i : i + 50_000])
                    yield pa.record_batch({"w1": pa.array(lanes[0][i : i + n]), "w2": pa.array(lanes[1][i : i + n]), "oid": pa.array(np.full(n, oid, np.int64)), "d1": pa.array(np.full(n, d1, np.int64)), "pos": pa.array(at[i : i + n].astype(np.int32))})

    return _of(docs, wanted).mapInArrow(walk, "w1 bigint, w2 bigint, oid bigint, d1 bigint, pos int").distinct()


def _repeated(windows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Windows that start in more than one document, with the smallest of these.

    The smallest are written before the join: both of its sides are then
    plain shuffles, of which Spark splits the partition of a passage that a
    great many documents share.
    """
    firsts = windows.groupBy("w1", "w2").agg(F.min("oid").alias("first"), F.max("oid").alias("last")).filter("first < last").drop("last")
    found = scratch.write(windows.join(scratch.write(firsts, f"{name}_firsts"), ["w1", "w2"]), name)
    scratch.drop(f"{name}_firsts")
    return found


def _longest(level: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(oid, d1, longest): the longest doubled run of each document that also starts in another one."""
    found, length = [], window
    while True:
        found.append(level.select("oid", "d1").distinct().withColumn("longest", F.lit(length)))
        behind = level.select("oid", "d1", (F.col("pos") - length).alias("pos"), F.col("w1").alias("v1"), F.col("w2").alias("v2"))
        twice = level.join(behind, ["oid", "d1", "pos"]).select(F.xxhash64("w1", "w2", "v1", "v2").alias("w1"), F.xxhash64("v2", "w1", "v1", "w2").alias("w2"), "oid", "d1", "pos")
        length *= 2
        level = _repeated(scratch.write(twice, f"twice{length}"), scratch, f"level{length}")
        scratch.drop(f"twice{length}")
        if level.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return scratch.write(out.groupBy("oid", "d1").agg(F.max("longest").alias("longest")), "longest")


def _cleaned(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(oid, d1, n_removed, kept_sha256, kept_text) of documents with windows to remove.

    spans: oid, texts (array of d1 and the windows' positions).
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part, rows = batch.slice(begin, 64), []
                for oid, text, texts in zip(part["oid"].to_pylist(), part["text"].to_pylist(), part["texts"].to_pylist(), strict=True):
                    words = text.split()
                    d1 = digest(b" ".join(words))[0]
                    for t in texts:
                        if t["d1"] == d1:
                            edge = np.zeros(len(words) + 1, np.int64)
                            np.add.at(edge, t["pos"], 1)
                            np.add.at(edge, np.asarray(t["pos"]) + window, -1)
                            gone = np.cumsum(edge)[:-1] > 0
                            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                            rows.append((oid, d1, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["oid", "d1", "n_removed", "kept_sha256", "kept"])

    return _of(docs, spans).mapInArrow(walk, "oid bigint, d1 bigint, n_removed bigint, kept_sha256 string, kept binary")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, longest_repeat.

    Words covered by a run of ``window`` words that also starts in a document
    with a smaller doc_id are removed; runs are judged on the input. Kept
    words are joined by one space. A null text has no words. A null doc_id
    counts as larger than any other; rows that share a doc_id do not remove
    each other's words. longest_repeat is the longest of window, 2 * window,
    4 * window ... at which a run of the document starts in another one too,
    0 if none does. Texts of any length go whole; repeated rows give repeated
    rows; other columns are not looked at, whatever their names; empty docs
    give an empty result.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    told = scratch.write(_prepare(docs, window), "told")
    groups = told.filter(F.col("n_words") >= window).groupBy("d1", "d2").agg(F.min("oid").alias("first"), F.max("oid").alias("last"))
    groups = scratch.write(groups, "groups")
    alone = told.join(groups.select(F.col("first").alias("oid"), "d1", "d2"), ["oid", "d1", "d2"], "left_semi")
    seeds = scratch.write(alone.select("oid", F.explode("seeds").alias("seed")), "seeds")
    common = scratch.write(seeds.groupBy("seed").agg(F.min("oid").alias("lo"), F.max("oid").alias("hi")).filter("lo < hi").select("seed"), "common")
    wanted = scratch.write(seeds.join(common, "seed").groupBy("oid").agg(F.collect_set("seed").alias("seeds")), "wanted")
    scratch.drop("seeds")
    level = _repeated(scratch.write(_windows(docs, wanted, window), "windows"), scratch, "level")
    scratch.drop("windows")
    spans = level.filter("first < oid").groupBy("oid", "d1").agg(F.collect_list("pos").alias("pos")).groupBy("oid").agg(F.collect_list(F.struct("d1", "pos")).alias("texts"))
    cleaned = _cleaned(docs, scratch.write(spans, "spans"), window).drop("kept").distinct()
    cleaned = scratch.write(cleaned, "cleaned")
    longest = _longest(level.drop("first"), window, scratch)

    # Copies of a text with a smaller doc_id go whole.
    copies = groups.filter("first < last").select("d1", "d2", "first")
    out = attach(told.drop("seeds"), copies, ["d1", "d2"], "oid")
    out = attach(out, cleaned.join(longest, ["oid", "d1"], "full"), ["oid", "d1"], "n_words")
    whole = F.coalesce(F.col("first") < F.col("oid"), F.lit(False))
    long_copy = F.when(F.col("first").isNotNull(), F.lit(window) * F.pow(F.lit(2), F.floor(F.log2(F.col("n_words") / F.lit(window))))).otherwise(F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        F.greatest(F.coalesce("longest", F.lit(0)), long_copy.cast("int")).alias("longest_repeat"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
