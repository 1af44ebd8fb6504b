"""The Jaccard join against brute force, its trees against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_exact_and_near import brute_components, corpus, docs

from lorespark.llm import jaccard_join as jj
from lorespark.llm import near_dedup as near
from lorespark.llm.jaccard_join import bitmap, cell_pairs, jaccard_join, leaf_overlap, n_first, width


def joined(spark, texts, n=5, percent=80, parts=3):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(docs(spark, texts, parts), n, percent).collect()}


def brute(texts, n=5, percent=80):
    return {i: x[:2] for i, x in brute_components(texts, n, percent).items()}


@pytest.fixture
def small(monkeypatch):
    """Few of everything, so that blocks, parts, cells and heavy shingles are met."""
    for name, value in (("BLOCK", 300), ("PART", 400), ("MANY", 4), ("CELL", 6), ("FAN", 2), ("CHUNK", 4096), ("LISTED", 1)):
        monkeypatch.setattr(jj, name, value)


def family(seed, n, edits, size=70):
    """A text and n - 1 more, each with some words of the one before changed."""
    rng = random.Random(seed)
    words, out = [f"f{seed}w{i}" for i in range(size)], []
    for _ in range(n):
        out.append(" ".join(words))
        for _ in range(edits):
            words[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("percent", [80, 55])
def test_join_equals_brute_force(spark, percent):
    texts = corpus(6)
    assert joined(spark, texts, 5, percent) == brute(texts, 5, percent)


@pytest.mark.parametrize("seed", [1, 2])
def test_join_with_small_blocks(spark, small, seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [t for s in range(4) for t in family(10 * seed + s, 14, 2)] + family(99, 40, 1)
    texts += [f"{passage} {' '.join(f'u{k}x{i}' for i in range(rng.randint(0, 12)))}" for k in range(30)]
    texts += [f"{' '.join(f'v{k}x{i}' for i in range(100))} {passage}" for k in range(30)] + [None, "", "a b", "A  b", "a b c"]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    want = brute(texts)
    assert joined(spark, texts) == want
    assert len({c for _, c in want.values()}) < len(texts) - 60


def test_a_chain_that_no_star_joins(spark, small):
    """Each text is linked to its neighbours only; all share a passage that is in every group."""
    texts = list(enumerate(family(7, 30, 4, 120)))
    random.Random(3).shuffle(texts)
    assert joined(spark, texts, parts=7) == brute(texts)


def test_odd_rows(spark):
    t = "one two three four five six seven"
    rows = [(None, t), (None, t), (None, "x y"), (3, t + " "), (3, "another text of some few words"), (9, "another text of some few words"), (4, None), (5, " \n"), (6, None)]
    odd = docs(spark, rows).withColumns({c: F.lit("?") for c in ("rep", "bits", "component", "k1", "d1", "n_shingles", "a.b")})
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join(odd).collect()), key=str)
    assert got == sorted([(None, 3, 3), (None, 3, 3), (None, 1, None), (3, 3, 3), (3, 2, 3), (9, 2, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6)], key=str)
    assert jaccard_join(odd.limit(0)).count() == 0


def test_first_shingles_hold_one_in_common():
    rng = random.Random(5)
    for _ in range(3000):
        percent, both = rng.choice([50, 80, 90]), rng.randint(1, 30)
        a, b = both + rng.randint(0, 8), both + rng.randint(0, 8)
        order = rng.sample(range(1000), a + b - both)
        x, y = sorted(order[:a]), sorted(order[a - both :])
        if 100 * both >= percent * (a + b - both):
            assert set(x[: n_first(a, percent)]) & set(y[: n_first(b, percent)])


def test_bounds_are_never_below_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        w = min(width(len(x)), width(len(y)))
        most = leaf_overlap(jj._folded([bitmap(x)], w), jj._folded([bitmap(y)], w), np.array([len(x)]), np.array([len(y)]))
        assert most[0] >= len(np.intersect1d(x, y))


@pytest.mark.parametrize("two", [False, True])
def test_trees_lose_no_pair_of_a_cell(two):
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 1 << 63, rng.integers(3, 400), dtype=np.uint64))
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(0, 1 << 63, 2, dtype=np.uint64)])) for _ in range(4)]
    comp = np.arange(len(sets)) // 2
    mine = np.arange(len(sets)) % 2 if two else np.zeros(len(sets), int)
    group = pa.table({"n_shingles": [len(x) for x in sets], "component": comp, "mine": mine, "bits": pa.array([bitmap(x) for x in sets], pa.binary()), "bi": [0] * len(sets), "bj": [int(two)] * len(sets)})
    for percent in (80, 50):
        left = {frozenset(p) for a, b in cell_pairs(group, percent) for p in zip(a.tolist(), b.tolist(), strict=True)}
        for i in range(len(sets)):
            for j in range(i):
                if comp[i] != comp[j] and (not two or mine[i] != mine[j]) and near.linked(sets[i], sets[j], percent):
                    assert frozenset((i, j)) in left
        assert len(left) < len(sets) ** 2 / 20
