"""URL filters, quality rules, mixing, sharding: rules told again in Python."""

import hashlib
import zlib
from collections import Counter
from datetime import datetime
from math import comb, log

import pytest
from pyspark.sql import functions as F

from lorespark.llm.mixing import mix, mix_rows, rates
from lorespark.llm.quality import HOLDOUT, RULES, STEPS, Risk, features, keep_good, quality_report, steps, verdict
from lorespark.llm.sharding import Topology, shard
from lorespark.llm.url_filter import captures_of, filter_urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


def day(d):
    return datetime(2024, 1, d)


def test_url_filter_as_of(spark):
    entries = spark.createDataFrame(
        [
            ("l", "bad.org", "block", day(5)), ("l", "bad.org", "remove", day(10)), ("l", "example.com", "block", day(1)),
            ("l", "ok.example.com", "allow", day(3)), ("m", "ok.example.com/x", "block", day(3)), ("l", None, "block", day(1)), ("l", "q.org", "what", day(1)),
        ],
        "list_name string, pattern string, action string, since timestamp",
    )
    captures = [
        (1, "http://bad.org/a", day(4)), (2, "http://bad.org/a", day(5)), (3, "https://sub.BAD.org:80/a?x", day(9)), (4, "http://bad.org/a", day(10)),
        (5, "http://ok.example.com/", day(2)), (6, "http://ok.example.com/y", day(4)), (7, "http://ok.example.com/x/z", day(4)), (8, "http://u@ok.example.com/xy", day(4)),
        (9, None, day(4)), (10, "no url", day(4)), (11, "http://bad.org/", None), (12, "http://notbad.org/", day(6)), (None, "http://bad.org/n", day(6)),
    ]
    df = spark.createDataFrame(captures, "page_id bigint, url string, fetched timestamp").withColumn("pattern", F.lit("clash"))
    got = {r["page_id"]: r["verdict"] for r in filter_urls(df, entries).collect()}
    assert got == {1: "none", 2: "block", 3: "block", 4: "none", 5: "block", 6: "allow", 7: "block", 8: "allow", 9: "none", 10: "none", 11: "none", 12: "none", None: "block"}
    assert {r["verdict"] for r in filter_urls(df, entries.limit(0)).collect()} == {"none"}
    assert filter_urls(df.limit(0), entries).count() == 0


def test_url_filter_long_urls_repeats_and_large_ids(spark):
    entries = spark.createDataFrame([("l", "bad.org", "block", day(1)), ("l", "ok.org/a/b", "block", day(1)), ("l", ".".join(["x"] * 30 + ["deep.org"]), "allow", day(1))], "list_name string, pattern string, action string, since timestamp")
    labels, segments = ".".join(["x"] * 2500 + ["bad.org"]), "/".join(["a", "b"] + ["s"] * 9000)
    rows = [(1, f"http://{labels}/", day(4)), (2, f"http://ok.org/{segments}", day(4)), (1 << 62, "http://bad.org/", day(4)), (3, "http://bad.org/", day(4)), (3, "http://bad.org/", day(4)), (4, "http://y." + "x." * 30 + "deep.org/", day(4)), (5, "http://ok.org/a", day(4))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, fetched timestamp").withColumns({c: F.lit(1) for c in ("row", "p", "key", "host", "labels", "verdict")})
    got = sorted((r["page_id"], r["verdict"]) for r in filter_urls(df, entries).collect())
    assert got == sorted([(1, "block"), (2, "block"), (1 << 62, "block"), (3, "block"), (3, "block"), (4, "allow"), (5, "none")])
    big = spark.createDataFrame([(1 << 62, "http://h.org/"), (-7, None)], "page_id bigint, url string")
    assert filter_urls(captures_of(big), entries).count() == 2


def test_url_filter_pattern_with_many_entries(spark):
    """A pattern that is blocked and allowed every six hours is judged as one with few entries is."""
    from datetime import timedelta

    log = [("l", "flip.org", "block" if k % 2 else "allow", day(1) + timedelta(hours=6 * k)) for k in range(100)] + [("m", "still.org", "block", day(3)), ("l", "flip.org", "remove", day(27))]
    entries = spark.createDataFrame(log, "list_name string, pattern string, action string, since timestamp")
    at = [day(1) + timedelta(hours=5 * k) for k in range(130)]
    df = spark.createDataFrame([(k, "http://www.flip.org/", t) for k, t in enumerate(at)] + [(1000, "http://still.org/", day(9)), (1001, "http://still.org/", None)], "page_id bigint, url string, fetched timestamp")
    got = {r["page_id"]: r["verdict"] for r in filter_urls(df, entries).collect()}
    want = {k: "none" if t >= day(27) else "block" if min(int((t - day(1)) / timedelta(hours=6)), 99) % 2 else "allow" for k, t in enumerate(at)}
    assert got == want | {1000: "block", 1001: "none"}


def brute_features(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("text", [None, "", " \t\n", "a", "a b c d e a b c d e", "é#1 x\n\nfoo\nfoo\n foo\nbar", "a a a a a a a", "x y z w v u\x0bx y z w v\x1cu " * 3, "w " * 3000])
def test_features(spark, text):
    got = features(docs(spark, [(1, text, "en", "s")])).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").first()
    assert tuple(got) == brute_features(text)


def brute_steps(good, risk):
    """Strictest safe step of each stratum and of the pool (None), by the exact binomial tail in whole numbers of rows."""
    groups = {None: []}
    for doc_id, stratum, text in good:
        n_words, chars, symbols, dup, rep = brute_features(text)
        lines = sum(1 for x in text.split("\n") if x.split())
        if n_words < 10 or 100 * rep > 20 * n_words or int(hashlib.md5(str(doc_id).encode()).hexdigest()[:4], 16) % HOLDOUT == 0:
            continue
        scores = (1000 * symbols, chars), (1000 * dup, lines), (1000 * rep, n_words), (100 * chars, n_words)
        for s in (stratum, None):
            groups.setdefault(s, []).append([any(x > ladder[k] * y for (x, y), (_, _, ladder) in zip(scores, RULES.values(), strict=True)) for k in range(STEPS)])
    out = {}
    for s, rows in groups.items():
        out[s] = STEPS
        for k in range(STEPS):
            n, lost = len(rows), sum(r[k] for r in rows)
            if sum(comb(n, i) * risk.alpha**i * (1 - risk.alpha) ** (n - i) for i in range(lost + 1)) > risk.delta / len(groups):
                out[s] = k
                break
    return out


def test_steps_hold_the_exact_bound(spark):
    """Good documents of three languages; en's first steps are safe and stricter ones are not, xx has too few labels and takes the pool's."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(20)) + (" " + "#" * 40 if i % 400 == 0 else " ##########" if i % 20 == 0 else "")
    rows = [(i, text(i), "en", "s") for i in range(2000)] + [(5000 + i, text(i * 20 + 1), "xx", "s") for i in range(20)] + [(6000 + i, text(7), None, "s") for i in range(3)]
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in rows[:-3]] + [(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    df, risk = docs(spark, rows), Risk(alpha=0.02, delta=0.05)
    scored = features(df.select("doc_id", "text", F.coalesce("lang", F.lit("?")).alias("stratum")))
    got = {r["stratum"]: r["step"] for r in steps(scored, labels, risk).collect()}
    assert got == brute_steps([(i, lang, t) for i, t, lang, _ in rows[:-3]], risk)
    assert 0 < got["en"] < STEPS and got["xx"] == 0 and got[None] > 0
    report = {r["doc_id"]: r for r in quality_report(df, labels, risk).collect()}
    assert {r["stratum"]: (r["step"], r["source"]) for r in report.values()} == {"en": (got["en"], "own"), "xx": (got[None], "pool"), "?": (got[None], "pool")}
    assert report[400]["kept"] is False and report[6000]["kept"] and report[1]["n_holdout"] > 300
    apart = [r for i, r in report.items() if i < 2000 and int(hashlib.md5(str(i).encode()).hexdigest()[:4], 16) % HOLDOUT == 0 and not r["base_failed"]]
    assert (report[1]["n_holdout"], report[1]["n_holdout_lost"]) == (len(apart), sum(not r["kept"] for r in apart))
    clash = df.withColumns({"stratum": F.lit(1), "own": F.lit(2), "step": F.lit(3), "n_words": F.lit(4), "a.b": F.lit(5)})
    kept = keep_good(clash, labels, risk)
    assert kept.columns == clash.columns
    assert sorted(r["doc_id"] for r in kept.filter("own = 2 and step = 3 and n_words = 4").collect()) == sorted(i for i, r in report.items() if r["kept"])


def test_the_pool_does_not_override_a_stratum_that_speaks_against_it(spark):
    """bad loses a tenth of 1,000 good documents at step 1, the pool next to nothing; few has 30 labels, one of them lost; sound 30, none lost."""
    one = F.when(F.col("stratum") == "bad", F.col("id") % 10 == 0).when(F.col("stratum") == "few", F.col("id") % 30 == 0).otherwise(F.lit(False))
    sizes = {"bad": 1000, "clean": 12_000, "few": 30, "sound": 30}
    at, parts = 0, []
    for name, n in sizes.items():
        parts.append(spark.range(at, at + n).withColumn("stratum", F.lit(name)))
        at += 100_020
    ids = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    scored = ids.withColumn("spoilt", one).select(F.col("id").alias("doc_id"), "stratum", F.lit(100).alias("n_words"), F.lit(500).alias("word_chars"), F.when(F.col("spoilt"), 400).otherwise(0).alias("n_symbols"), F.lit(5).alias("n_lines"), F.lit(0).alias("n_dup_lines"), F.lit(0).alias("n_repeat_words"))
    # The label of few that is lost must not be one that is kept apart.
    labels = scored.select("doc_id", F.lit(1).alias("quality"))
    lost_of_few = scored.filter("stratum = 'few' and n_symbols > 0").filter(~F.expr(f"conv(substring(md5(cast(doc_id as string)), 1, 4), 16, 10) % {HOLDOUT} = 0")).count()
    chosen = {r["stratum"]: r for r in steps(scored, labels).collect()}
    assert lost_of_few == 1 and chosen[None]["step"] == 7 == chosen["clean"]["step"]
    assert {s: (chosen[s]["step"], chosen[s]["few"]) for s in ("bad", "few", "sound")} == {"bad": (0, False), "few": (0, True), "sound": (0, True)}
    got = verdict(scored, steps(scored, labels)).groupBy("stratum").agg(F.max("step").alias("step"), F.first("source").alias("source"), F.count_if(~F.col("kept")).alias("lost")).collect()
    assert {r["stratum"]: tuple(r)[1:] for r in got} == {"bad": (0, "none", 0), "clean": (7, "own", 0), "few": (0, "none", 0), "sound": (7, "pool", 0)}


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality_report(docs(spark, [(1, "a b", None, "s"), (2, None, "en", "s"), (3, " ".join(map(str, range(30))), None, None)]), labels).collect()
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in got} == {1: (True, False), 2: (True, False), 3: (False, True)}
    assert quality_report(docs(spark, []), labels).count() == 0


def test_mixing(spark):
    rows = [(i, "x" * 10, "en", "big") for i in range(4000)] + [(10_000 + i, "x" * 10, "en", "small") for i in range(500)] + [(None, None, "en", None)]
    df = docs(spark, rows)
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    rate = {r["source"]: r["rate"] for r in rates(df, weights).collect()}
    assert rate["big"] == pytest.approx(0.5625) and rate["small"] == pytest.approx(4.5) and rate["?"] == 0
    got = mix(df, weights).collect()
    n = Counter(r["source"] for r in got)
    assert abs(n["big"] - 2250) < 200 and abs(n["small"] - 2250) < 200
    per = Counter(r["doc_id"] for r in got)
    assert all(per[r["doc_id"]] == r["copies"] for r in got)
    zero = sum(1 for i in range(4000) if i not in per) / 4000
    assert zero == pytest.approx(2.71828**-0.5625, abs=0.03)
    assert mix(df.limit(0)).count() == 0
    heavy = {r["doc_id"]: r["copies"] for r in mix(docs(spark, [(1, "x", "en", "a"), (2, "y", "en", "b")]), spark.createDataFrame([("a", 1.0)], "source string, weight double"), epochs=900.0).collect()}
    assert set(heavy) == {1} and abs(heavy[1] - 1800) < 200
    assert sorted(map(str, mix(df, weights).collect())) == sorted(map(str, got))


def test_mixing_keeps_columns_with_any_names(spark):
    names = ["_key", "_source", "_us", "_parts", "_cdf", "_deal", "c0", "copy", "copies", "shuffle_key", "a.b"]
    df = docs(spark, [(i, "xy" * (i % 5), "en", "s" if i % 3 else None) for i in range(60)] + [(None, None, "en", "s")] * 3).withColumns({c: F.lit(c) for c in names})
    rows, full = mix_rows(df), mix(df)
    assert rows.columns == df.columns and full.columns == [c for c in df.columns if c not in ("copy", "copies", "shuffle_key")] + ["copy", "copies", "shuffle_key"]
    got = rows.collect()
    assert got and all(r[c] == c for r in got for c in names)
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in full.collect())
    assert all(isinstance(r["copy"], int) and r["copy"] < r["copies"] for r in full.collect())


def draw(level, node, child, weight, key):
    u = (int(hashlib.md5(f"{level}/{node}/{child}/{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    return -log(u) / weight


def descend_by_hand(weights, key):
    first = lambda level, node, ws: min(range(len(ws)), key=lambda i: draw(level, node, i, ws[i], key))
    region = first("region", "root", [sum(map(sum, r)) for r in weights])
    rack = first("rack", region, [sum(x) for x in weights[region]])
    leaf = first("shard", f"{region}.{rack}", weights[region][rack])
    before = sum(len(x) for r in weights[:region] for x in r) + sum(len(x) for x in weights[region][:rack])
    return before + leaf


@pytest.mark.parametrize("weights", [Topology.even().weights, (((1.0, 2.5), (3.0,)), ((0.5, 1.0, 1.0),), ((4.0,), (1.0, 1.0)))])
def test_sharding_equals_a_descent_by_hand(spark, weights):
    rows = [(i * 7919 - 50, "é" * (i % 9), "en", "s") for i in range(400)] + [(5, None, "en", "s"), (5, "x", "en", "s"), (None, "y", "en", "s"), (None, "y", "en", "s"), (None, None, "en", "s")]
    key = lambda i, t: str(i) if i is not None else "text:" + hashlib.md5((t or "").encode()).hexdigest()
    got = shard(docs(spark, rows), Topology(weights)).collect()
    grown = (*weights, ((1.0,),))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), descend_by_hand(weights, key(i, t)), descend_by_hand(grown, key(i, t))) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    # Slots: by sub-range of the key's hash, then doc_id; rows without doc_id stand anywhere.
    place = lambda i: int(hashlib.md5(f"slot/{i}".encode()).hexdigest()[:8], 16) % 1024
    for s in {r["shard"] for r in got}:
        mine = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        told = [(place(r["doc_id"]), r["doc_id"]) for r in mine if r["doc_id"] is not None]
        assert told == sorted(told)


def test_sharding_is_gapless_and_grows_into_the_new_shard(spark):
    rows = [(i, "é" * (i % 7), "en", "s") for i in range(6000)] + [(3, "x", "en", "s"), (3, "x", "en", "s"), (None, "y", "en", "s"), (None, None, "en", "s")]
    got = shard(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {r["shard"] for r in got} == set(range(40))
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(len(s) - 150) < 60 for s in slots.values())
    assert 80 < sum(r["grown_shard"] == 40 for r in got) < 220
    one = {r["doc_id"]: r for r in got}[6]
    assert one["size"] == 28 and one["text_crc32"] == zlib.crc32(("é" * 6).encode())
    assert shard(docs(spark, [])).count() == 0


def test_weights_move_rows_only_in_changed_subtrees(spark):
    df = docs(spark, [(i, "x", "en", "s") for i in range(3000)])
    even = Topology.even()
    heavy = Topology((((1.0, 1.0, 1.0, 3.0), (1.0,) * 4), *even.weights[1:]))
    a, b = ({r["doc_id"]: r["shard"] for r in shard(df, t).collect()} for t in (even, heavy))
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    assert moved and all(to // 8 == 0 for _, to in moved)
    assert all(to // 4 == 0 for frm, to in moved if frm // 8 == 0)
    assert all(to == 3 for frm, to in moved if frm // 4 == 0)
