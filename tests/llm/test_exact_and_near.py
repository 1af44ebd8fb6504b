"""Exact dedup, near-dedup, components and substring dedup against brute force."""

import hashlib
import random
import re

import pytest

from lorespark.llm import near_dedup as near
from lorespark.llm.common import Scratch
from lorespark.llm.components import components
from lorespark.llm.exact_dedup import drop_copies, exact_dedup
from lorespark.llm.near_dedup import drop_near_copies, near_dedup
from lorespark.llm.substring import substring_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, parts=3):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def words_of(text):
    return (text or "").encode().split()


def corpus(seed, n=60):
    """Texts with exact copies, near copies, shared passages, nulls, empties and a very long one."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(70)]
    base = [[word() for _ in range(rng.randint(1, 160))] for _ in range(n)]
    out = [" ".join(w) for w in base]
    for w in base[:12]:
        x = list(w)
        for _ in range(max(1, len(x) // 60)):
            x[rng.randrange(len(x))] = word()
        out.append(" ".join(x))
    out += [" ".join(base[0]), "  " + "\n".join(base[0]).upper(), "", None, " \t", "a b", "a b", "a  b"]
    for w in base[20:26]:
        at = rng.randrange(len(w))
        out.append(" ".join(w[:at] + passage[: rng.randint(45, 70)] + w[at:]))
    out.append(" ".join(word() for _ in range(6000)))
    rng.shuffle(out)
    return list(enumerate(out))


def brute_components(texts, n, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_exact_dedup(spark):
    texts = corpus(1)
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup(docs(spark, texts, 20)).collect()}
    groups = {}
    for i, t in texts:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    for norm, rows in groups.items():
        keep = min(rows)[1]
        for _, i in rows:
            assert got[i] == (keep, len(rows), i == keep, hashlib.sha256(norm.encode()).hexdigest())


def test_exact_dedup_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "ab"), (2, "a  b"), (3, None), (4, ""), (None, None)]
    got = exact_dedup(docs(spark, rows, 1)).collect()
    assert len(got) == 7 and sum(r["kept"] for r in got) == 2
    assert {r["keep_id"] for r in got} == {2, 3}
    assert sorted((r["doc_id"], r["text"]) for r in drop_copies(docs(spark, [(1, "x"), (1, "x"), (2, "y")])).collect()) == [(1, "x"), (2, "y")]
    assert exact_dedup(docs(spark, [], 1)).count() == 0


def test_exact_dedup_ignores_other_columns(spark):
    from pyspark.sql import functions as F

    odd = docs(spark, [(1, "x"), (2, "x ")]).withColumns({"run": F.lit("?"), "keep_id": F.lit(9), "rank": F.lit(None)})
    assert {r["doc_id"]: r["kept"] for r in exact_dedup(odd).collect()} == {1: False, 2: True}
    assert drop_copies(odd).columns == odd.columns


def test_drops_keep_columns_with_any_names(spark):
    from pyspark.sql import functions as F

    t = "one two three four five six seven"
    names = ["_sha", "_keep_id", "_chars", "_oid", "_mark", "_row", "kept", "once", "n", "run", "rank", "a.b", "d1", "sig", "component"]
    odd = docs(spark, [(1, t), (2, t + " "), (3, t + " eight"), (None, "x y"), (None, "x y"), (None, "x  y")]).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in names})
    exact, near_ = drop_copies(odd), drop_near_copies(odd)
    assert exact.columns == near_.columns == odd.columns
    got = exact.collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("2", t + " "), ("3", t + " eight"), ("None", "x  y")]
    assert all(r[c] == c + ("-" if r["doc_id"] is None else str(r["doc_id"])) for r in got for c in names)
    assert len(near_.collect()) == 4 - 1
    assert drop_copies(odd.limit(0)).count() == drop_near_copies(odd.limit(0)).count() == 0


def test_rows_without_ids_or_repeated_ids_are_dropped_one_by_one(spark):
    rows = [(None, "a b"), (None, "ab"), (None, "c"), (7, "d"), (7, "e"), (7, "d "), (8, "e"), (9, None), (10, "")]
    left = sorted(((r["doc_id"], r["text"]) for r in drop_copies(docs(spark, rows)).collect()), key=str)
    assert left == sorted([(None, "a b"), (None, "c"), (7, "d "), (7, "e"), (9, None)], key=str)


def test_sides_of_joins_are_measured(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lorespark.llm import common

    small = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.lit(1), F.lit(2)).alias("l"))
    assert common.fits(small) and not common.fits(small, 49)
    left = spark.range(200).select((F.col("id") % 60).alias("id"), F.col("id").alias("k"))
    rows = lambda how: sorted(map(str, common.attach(left, small, ["id"], "k", how).collect()))
    want = rows("left"), rows("inner")
    monkeypatch.setattr(common, "SMALL_BYTES", 40_000)
    assert not common.fits(small)
    assert (rows("left"), rows("inner")) == want


@pytest.mark.parametrize("n", [4, 5])
def test_near_dedup(spark, n):
    texts = corpus(2)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup(docs(spark, texts), n).collect()}
    assert got == brute_components(texts, n, 80)


def test_near_dedup_joins_what_stars_miss(spark, monkeypatch):
    """A chain of near copies whose smallest is far from the last, in small blocks."""
    monkeypatch.setattr(near, "BLOCK", 4)
    rng = random.Random(5)
    w = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(24):
        texts.append((i * 7 % 24, " ".join(w)))
        at = rng.randrange(len(w))
        w = w[:at] + [f"x{i}a", f"x{i}b", f"x{i}c"] + w[at + 3 :]
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup(docs(spark, texts), 4).collect()}
    assert got == brute_components(texts, 4, 80)


def test_a_bucket_of_many_components_is_cut_by_a_second_band(spark):
    """5,000 texts that agree in one band, in pairs of near copies: each pair is linked, in groups of its own size."""
    from pyspark.sql import functions as F

    texts = [(i, " ".join(f"t{i // 2}w{k}" for k in range(60)) + " end" * (i % 2)) for i in range(5000)]
    df, scratch = docs(spark, texts), Scratch(spark, "t")
    told = scratch.write(near._prepare(df, 5), "told")
    same = F.expr(f"overlay(sig placing unhex('{'ab' * 2 * near.ROWS}') from 1)")
    reps = scratch.write(told.select(F.col("doc_id").alias("rep"), "d1", "d2", "oid", "mark", "n_shingles", same.alias("sig")), "reps")
    rows = reps.select(F.lit(77).cast("bigint").alias("key"), F.lit(0).alias("band"), "rep", F.lit(0).cast("bigint").alias("hub"), F.lit(5000).cast("bigint").alias("n"))
    comp = spark.createDataFrame([], "node bigint, component bigint")
    assert near._cut(rows.select("key", "band", "rep", F.col("rep").alias("component")), reps, scratch).agg(F.max("n")).first()[0] < 20
    got = near._across(rows, reps, comp, df, 5, 80, 0.66, Scratch(spark, "t")).collect()
    assert sorted((min(r), max(r)) for r in got) == [(i, i + 1) for i in range(0, 5000, 2)]


@pytest.mark.parametrize("block", [16, 1024])
def test_links_do_not_depend_on_a_buckets_size(spark, monkeypatch, block):
    """Near copies whose signatures share one band and no other, in a bucket below and above a block; above it, they were lost."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(near, "BLOCK", block)
    texts = [(i, " ".join(f"t{i // 2}w{k}" for k in range(60)) + " end" * (i % 2)) for i in range(200)]
    df, scratch = docs(spark, texts), Scratch(spark, "t")
    told = scratch.write(near._prepare(df, 5), "told")
    # A text and its copy differ in the last hash of every band but the first, which all texts share.
    same = F.concat(F.unhex(F.lit("ab" * 2 * near.ROWS)), *[x for b in range(1, near.BANDS) for x in (F.unhex(F.lpad(F.hex(F.floor(F.col("doc_id") / 2) * 64 + b), 16, "0")), F.unhex(F.lpad(F.hex(F.col("doc_id")), 4, "0")))])
    reps = scratch.write(told.select(F.col("doc_id").alias("rep"), "d1", "d2", "oid", "mark", "n_shingles", same.alias("sig")), "reps")
    rows = reps.select(F.lit(77).cast("bigint").alias("key"), F.lit(0).alias("band"), "rep", F.lit(0).cast("bigint").alias("hub"), F.lit(200).cast("bigint").alias("n"))
    comp = spark.createDataFrame([], "node bigint, component bigint")
    got = near._across(rows, reps, comp, df, 5, 80, 0.66, scratch).collect()
    assert sorted((min(r), max(r)) for r in got) == [(i, i + 1) for i in range(0, 200, 2)]


def test_near_dedup_odd_rows(spark):
    t = "one two three four five six"
    got = near_dedup(docs(spark, [(5, t), (5, t), (None, t.upper()), (6, None), (7, ""), (None, None)])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got if r["n_shingles"]) == [("5", 5, True), ("5", 5, True), ("None", 5, False)]
    assert all(r["component_id"] == r["doc_id"] for r in got if not r["n_shingles"])
    assert near_dedup(docs(spark, [], 1)).count() == 0
    kept = drop_near_copies(docs(spark, [(1, t), (2, t), (3, "z")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_near_dedup_null_and_repeated_ids(spark):
    t, u, v, w = (" ".join(f"{c}{i}" for i in range(30)) for c in "tuvw")
    near_t, near_u = t + " more", u + " more"
    left = lambda rows: sorted(((r["doc_id"], r["text"]) for r in drop_near_copies(docs(spark, rows)).collect()), key=str)
    assert left([(1, t), (None, t), (None, u)]) == [(1, t), (None, u)]
    assert left([(1, t), (7, near_t), (7, u)]) == [(1, t), (7, u)]
    assert left([(None, t), (None, t), (None, t.upper()), (None, ""), (None, None)]) in [sorted([(None, x), (None, ""), (None, None)], key=str) for x in (t, t.upper())]
    # Two null rows near 1 and 2, and two rows of 3 near 4 and 5, do not link these.
    rows = [(1, t), (2, u), (None, near_t), (None, near_u), (3, v), (3, w), (4, v + " x"), (5, w + " x"), (None, "z")]
    got = sorted((tuple(r)[0::2] + (r["kept"],) for r in near_dedup(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (None, 1, False), (None, 2, False), (3, 3, True), (3, 3, True), (4, 3, False), (5, 3, False), (None, None, True)], key=str)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 230)] + [(300, x) for x in range(301, 340)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t"), "c").collect()}
    up = {}
    root = lambda x: x if up.get(x, x) == x else root(up[x])
    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    nodes = {x for e in edges for x in e}
    assert got == {x: root(x) for x in nodes if root(x) != x}


def brute_removed(texts, window):
    first = {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        w = words_of(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = {}
    for i, t in texts:
        w = words_of(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("window", [50, 8])
def test_substring_dedup(spark, window):
    texts = corpus(4)
    got = {r["doc_id"]: tuple(r)[1:4] for r in substring_dedup(docs(spark, texts), window).collect()}
    assert got == brute_removed(texts, window)


def test_substring_levels_and_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(430))
    rows = [(1, long + " x"), (2, "y " + long), (3, None), (4, ""), (None, long), (5, "a b"), (5, "a b")]
    got = substring_dedup(docs(spark, rows)).collect()
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert len(got) == 7
    assert by[(1, 431)]["n_removed"] == 0 and by[(2, 431)]["n_removed"] == 430 and by[(None, 430)]["n_removed"] == 430
    assert by[(1, 431)]["longest_repeat"] == 400
    assert substring_dedup(docs(spark, [], 1)).count() == 0
