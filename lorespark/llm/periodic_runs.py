"""Periodic runs of words, by a harmonic grid and prefix hashes.

A stretch of words has period q if words q apart are identical. In a run of
period q and length L, the L - q places at which a word equals the one q
behind it follow each other; as L is at least ``times * q`` and ``least``,
there are at least gap(q) = max(least - q, (times - 1) * q) of them, so one of
the places 0, gap, 2 * gap, ... is among them. These grid points are n / gap(q)
for a period and n log n for all of them together. For all pairs of a period
and a grid point at once (in blocks of bounded size) NumPy compares the two
words, then, by prefix hashes, the half gaps around them, and for the few pairs
left finds by binary search how far the match goes both ways. Of the pairs of
one stretch only the first is searched.

What hashes say is verified on the words; where a hash was wrong, the period's
stretches are found by comparing all words. Runs found for several periods are
one: a run of three periods with a shorter period has one that divides it, and
the same ends, so the shortest period stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import documents, words_of
from lorespark.llm.hashing import LANES, mixed

#: Shortest run in words, and fewest periods in it.
LEAST, TIMES = 24, 3
#: Pairs of a period and a grid point that are looked at in one step.
PAIRS = 1 << 18

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Prefixes:
    """Prefix hashes of a row of words, given as small integers."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.n = n
        self.power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, LANES[0], np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(LANES[1])) * self.power[:n])])

    def equal(self, at: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from ``at`` on and those q behind them look the same; the places must exist."""
        here = self.sums[at + size] - self.sums[at]
        return here * self.power[q] == self.sums[at + q + size] - self.sums[at + q]

    def ahead(self, at: np.ndarray, q: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """For each pair how many words from ``at`` on (back: before it) match those q behind them, ``limit`` at most."""
        low, high = np.zeros_like(limit), limit + 1
        while (high - low > 1).any():
            mid = (low + high) // 2
            same = self.equal(at - mid if back else at, q, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid)
        return low


def _stretches(ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of each stretch of places whose word equals the one q behind, by comparing all words."""
    same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return edges[::2], edges[1::2]


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period. ids: the words as integers, equal for equal words."""
    n = len(ids)
    if n < max(least, times):
        return []
    periods = np.arange(1, n // times + 1)
    gaps = np.maximum(least - periods, (times - 1) * periods)
    points = -(-(n - periods) // gaps)
    ends = np.cumsum(points)
    hashed, found, wrong = None, [], []
    done = 0
    while done < len(periods):
        base = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        # A period has n / gap points, so a block holds PAIRS of them, or those of one period; these are cut as well.
        of, count = periods[done:upto], points[done:upto]
        first_of = ends[done:upto] - count - base
        for begin in range(0, int(count.sum()), PAIRS):
            number = np.arange(begin, min(begin + PAIRS, int(count.sum())))
            which = np.searchsorted(first_of, number, "right") - 1
            q, gap = of[which], gaps[done:upto][which]
            at = (number - first_of[which]) * gap
            hit = np.flatnonzero(ids[at] == ids[at + q])
            if not len(hit):
                continue
            hashed = hashed or Prefixes(ids)
            q, gap, at = q[hit], gap[hit], at[hit]
            # A point whose whole gap before it matches lies in the stretch of the point before.
            before = np.maximum(at - gap, 0)
            first = (at < gap) | (ids[before] != ids[before + q]) | ~hashed.equal(before, q, at - before)
            if begin:
                first[0] = True
            heads = np.flatnonzero(first)
            last = at[np.append(heads[1:], len(at)) - 1]
            q, gap, at = q[heads], gap[heads], at[heads]
            half = gap // 2
            right = hashed.equal(at, q, np.minimum(half, n - at - q)) & (at + q + half <= n)
            left = hashed.equal(np.maximum(at - half, 0), q, np.minimum(half, at)) & (at >= half)
            near = np.flatnonzero(right | left)
            q, gap, at, last = q[near], gap[near], at[near], last[near]
            if len(q):
                start = at - hashed.ahead(at, q, at, True)
                end = at + hashed.ahead(at, q, n - at - q, False)
                wrong.append(q[last >= end])
                long = end - start >= gap
                found.append(np.stack([start[long], end[long] + q[long], q[long]]))
        done = upto
    return _verified(ids, found, wrong, least, times) if found or wrong else []


def _verified(ids: np.ndarray, found: list[np.ndarray], wrong: list[np.ndarray], least: int, times: int) -> list[tuple[int, int, int]]:
    """Runs with the shortest of the periods found for them, once each, after their words have been compared."""
    bad = set(np.concatenate(wrong).tolist()) if wrong else set()
    by_ends: dict[tuple[int, int], list[int]] = {}
    for s, e, q in sorted(set(map(tuple, np.concatenate(found, axis=1).T.tolist())), key=lambda x: x[2]) if found else []:
        known = by_ends.setdefault((s, e), [])
        if any(q % k == 0 for k in known):
            continue
        if np.array_equal(ids[s : e - q], ids[s + q : e]):
            known.append(q)
        else:
            bad.add(q)
    for q in sorted(bad):
        for s, e in zip(*(x.tolist() for x in _stretches(ids, q)), strict=True):
            if e - s + q >= max(least, times * q):
                by_ends.setdefault((s, e + q), []).append(q)
    return sorted((s, e - s, min(qs)) for (s, e), qs in by_ends.items() if qs)


def _numbered(words: list[bytes]) -> np.ndarray:
    index: dict[bytes, int] = {}
    return np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0. A run
    is a stretch of at least ``least`` words and ``times`` (2 at least) of its
    smallest period that no neighbouring word extends. collapsed joins by one
    space the words that no run contains after its first period. A null or
    empty text has no words, no runs and an empty collapsed text; texts of any
    length go whole, each in the task that reads it; a null doc_id is handed
    on; repeated rows give repeated rows; other columns are not looked at,
    whatever their names; empty docs give an empty result.
    """
    if times < 2 or least < 1:
        raise ValueError("a run holds its period twice at least")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part, sizes, all_runs, texts = batch.slice(begin, 256), [], [], []
                for text in part["text"].to_pylist():
                    words = text.split()
                    runs = find_runs(_numbered(words), least, times) if len(words) >= least else []
                    sizes.append(len(words))
                    all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    texts.append(_collapsed(words, runs))
                yield pa.record_batch({"doc_id": part["doc_id"], "n_words": pa.array(sizes, pa.int64()), "runs": pa.array(all_runs, kind), "collapsed": pa.array(texts, pa.binary())})

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    told = texts.mapInArrow(walk, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed binary")
    return told.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_echoes(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs; in a tenth of them, by the CRC-32 h of the doc_id, the text from word a on repeats its first p words.

    With n words and g = h div 10: a = g mod n, p = 1 + (n - a) div (3 + g mod
    8). Texts without words, and rows without a doc_id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("_h")).withColumn("_words", F.when(F.col("_h") % 10 == 0, words_of(F.col("text"))))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    placed = chosen.withColumns({"_n": n, "_a": F.when(n > 0, (g % n).cast("int"))})
    left = F.col("_n") - F.col("_a")
    p = (F.floor(left / (3 + F.floor(F.col("_h") / 10) % 8)) + 1).cast("int")
    head, period = F.slice("_words", F.lit(1), F.col("_a")), F.slice("_words", F.col("_a") + 1, p)
    echo = F.slice(F.flatten(F.array_repeat(period, F.ceil(left / p).cast("int"))), F.lit(1), left)
    return placed.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(F.concat(head, echo), " ")).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: the first. Null without runs."""
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda best, x: F.when(more(best, x), x).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = periodic_runs(with_echoes(documents(spark, sf_dir)))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = told.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
