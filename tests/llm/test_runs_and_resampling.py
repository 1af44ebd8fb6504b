"""Periodic runs and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import periodic_runs as periodic
from lorespark.llm import resampling
from lorespark.llm.periodic_runs import find_runs, op11_periodic_runs, periodic_runs, strongest
from lorespark.llm.resampling import bucket_counts, importance_resample, op12_importance_resampling, packed

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS).repartition(parts)


def brute_runs(words, least=24, times=3):
    """Every stretch at every period, the shortest period of equal stretches."""
    n, best = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(rng):
    n, k = rng.randint(1, 260), rng.choice([1, 2, 3, 10, 1000])
    x = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        for i in range(a, a + rng.randint(1, n - a)):
            x[i] = x[a + (i - a) % p]
    return x


def test_runs_of_random_rows():
    rng = random.Random(1)
    for _ in range(600):
        x, (least, times) = random_words(rng), rng.choice([(24, 3), (6, 2), (1, 2), (10, 4)])
        assert find_runs(np.array(x), least, times) == brute_runs(x, least, times)


def test_runs_in_blocks_of_a_few_pairs(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 7)
    rng = random.Random(2)
    for _ in range(150):
        x = random_words(rng)
        assert find_runs(np.array(x)) == brute_runs(x)


def test_runs_where_hashes_lie(monkeypatch):
    """With hashes that call everything equal, the comparison of words still finds the runs."""
    rng = random.Random(3)
    rows = [random_words(rng) for _ in range(100)]
    monkeypatch.setattr(periodic, "mixed", lambda x: x * np.uint64(0))
    for x in rows:
        assert find_runs(np.array(x)) == brute_runs(x)
    # The parity word fools prefix hashes modulo 2^64, whatever their base.
    monkeypatch.undo()
    parity = np.array([bin(i).count("1") & 1 for i in range(4096)])
    assert (0, 9007, 3000) in find_runs(np.concatenate([np.tile(parity[:3000], 3), parity[:7]]))


def test_long_texts_stay_cheap():
    assert find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert find_runs(np.arange(300_000)) == []


def echoed(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or i is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (k - a) % p] for k in range(a, n)]


def test_op11_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [(i, " ".join(f"w{x}é" for x in random_words(rng))) for i in range(160)]
    texts += [(500, None), (501, ""), (502, " \t\n"), (503, "a  b\x0bc"), (504, "x " * 3000), (505, "x " * 3000), (None, "y " * 30), (7, texts[7][1]), (506, "long " + "z" * 100_000)]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in texts:
        words = echoed(i, t)
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(told), sha(" ".join(brute_collapsed(words, runs)))))
    assert sorted(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    assert sum(1 for w in want if w[1]) > 20


def test_periodic_runs_of_odd_tables(spark):
    odd = docs(spark, [(1, "a b " * 12), (1, "a b " * 12)]).withColumns({"runs": F.lit(1), "collapsed": F.lit("?"), "words": F.lit(2)})
    got = periodic_runs(odd).collect()
    assert [(r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got] == [(24, [(0, 24, 2)], "a b")] * 2
    assert periodic_runs(odd.limit(0)).count() == 0
    tied = spark.sql("select array(named_struct('start', 1L, 'length', 30L, 'period', 10L), named_struct('start', 5L, 'length', 60L, 'period', 20L), named_struct('start', 6L, 'length', 61L, 'period', 20L)) as r")
    assert tied.select(strongest(F.col("r")).alias("b")).first()["b"]["start"] == 6
    with pytest.raises(ValueError):
        periodic_runs(odd, times=1)


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, max_run=1):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    return words, [" ".join(words[i : i + k]) for k in range(1, max_run + 1) for i in range(len(words) - k + 1)]


def brute_resample(texts, target, percent, min_words, buckets, max_run, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in side for f in features(x, max_run)[1]) for side in ([x for _, x in texts], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, x in texts:
        words, fs = features(x, max_run)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough, 1):
        r.append(k if k <= percent * len(enough) // 100 else None)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in rows), key=str)


def some_texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcDEé9_") for _ in range(rng.randint(1, 4)))
    return [(i, rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("max_run", [1, 3])
def test_resampling_equals_brute_force(spark, monkeypatch, max_run):
    monkeypatch.setattr(resampling, "BLOCK", 500)
    texts = some_texts(1, 400) + [(900, None), (901, ""), (902, "--- !"), (903, "long text " * 5000), (None, "a b c d e " * 9)]
    target = [t for _, t in some_texts(2, 20)]
    got = importance_resample(docs(spark, texts, 7), docs(spark, list(enumerate(target))), 15, 10, 300, max_run, 7)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(texts, target, 15, 10, 300, max_run, 7)


def test_resampling_of_odd_tables(spark):
    texts, target = some_texts(3, 50), docs(spark, some_texts(4, 5))
    odd = docs(spark, texts).withColumns({c: F.lit("?") for c in ("rank", "score", "place", "part", "short", "stream", "n_words")})
    plain = sorted(map(tuple, importance_resample(docs(spark, texts), target).collect()), key=str)
    assert sorted(map(tuple, importance_resample(odd, target).collect()), key=str) == plain
    assert importance_resample(odd.limit(0), target).count() == 0
    none = importance_resample(docs(spark, texts), target.limit(0), percent=100, min_words=0)
    assert sorted(r["rank"] for r in none.collect()) == list(range(1, 51))
    twice = importance_resample(docs(spark, [(1, "a " * 30)] * 6), target, percent=50).collect()
    assert sorted(r["rank"] or 0 for r in twice) == [0, 0, 0, 1, 2, 3]
    with pytest.raises(ValueError):
        packed(odd, buckets=1 << 17)


def test_streams_and_counts(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 64)
    blocks = packed(docs(spark, [(i, "x y x") for i in range(50)] + [(99, None)], 1), 1000)
    rows = blocks.collect()
    assert len(rows) > 5 and sum(len(r["stream"]) for r in rows) == 2 * 150 and sum(len(r["ids"]) for r in rows) == 51
    want = {zlib.crc32(b"x") % 1000: 100, zlib.crc32(b"y") % 1000: 50}
    assert {r["bucket"]: r["n"] for r in bucket_counts(blocks, 1000).collect()} == want


def test_op12_draws_a_tenth(spark, tmp_path):
    docs(spark, some_texts(5, 300)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "abc DDE 9é")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute_resample(some_texts(5, 300), ["abc DDE 9é"], 10, 20, 10_000, 1, 2024)
    got = op12_importance_resampling(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], *r[2:]) for r in want), key=str)
