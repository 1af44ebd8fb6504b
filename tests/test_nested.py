"""Nested elements, closures, phrases, approximate search and walks against plain Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lorespark.operators import approx, phrases
from lorespark.operators.closure import reachable
from lorespark.operators.transcript import longest_spans, pack, text_chunks, word_spans
from lorespark.operators.walks import walk
from lorespark.sources import catalog, elements
from lorespark.sources.datasheets import weapon_name
from lorespark.streaming.game import legal_events


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id bigint, html string")


def without(spark, html, *classes):
    return elements.without(pages(spark, html), list(classes)).first()["html"]


def test_tokens_put_together_are_the_page(spark):
    html = """<!DOCTYPE html><div a='x>y' class="q">1 < 2 <br/>&amp;<!-- <div> --><script>if (a < b) x = "</div>";</script></DIV>\n<p>é<p>"""
    told = elements.tokens(pages(spark, html, None, "")).orderBy("at").collect()
    assert "".join(r["token"] for r in told) == html
    assert [(r["tag"], r["step"], r["level"]) for r in told if r["tag"]] == [("div", 1, 1), ("br", 0, None), ("div", -1, 1), ("p", 1, 1), ("p", 1, 2)]


def test_removed_elements_may_hold_their_like(spark):
    assert without(spark, '<div>a<div class="x fluff y">b<div>c</div>d<p>e</div>f</div>g', "fluff") == "<div>af</div>g"
    assert without(spark, '<span class=fluff>a<span>b</span></span>c<div class="fluffy">d</div>', "fluff") == 'c<div class="fluffy">d</div>'
    assert without(spark, "<p class='a'>1</p>2<p class='b'><b>3</b></p>4<img class='a'>5", "a", "b") == "245"
    assert without(spark, 'a<div class="x">never closed <p>b</p>', "x") == "a"
    assert without(spark, "</div>a</div><div class='x'>b</div>c", "x") == "</div>a</div>c"
    assert without(spark, None, "x") is None and without(spark, "", "x") == "" and without(spark, '<p class="x">a</p>', "x") == ""
    assert without(spark, "<p>a</p>") == "<p>a</p>"
    deep = "<div>" * 300 + '<div class="x">gone</div>' + "kept" + "</div>" * 300
    assert without(spark, deep, "x") == deep.replace('<div class="x">gone</div>', "")


def test_tables_in_tables(spark):
    inner = "<table><tr><td>i1</td><td>i2 <b>&lt;b&gt;</b></td></tr><tr><th>i3</th></tr></table>"
    html = f"<table><tr><th>h</th></tr><tr><td>a {inner} b</td><td>c{inner}</td></tr></table><table><tr><td>z</table>"
    got = elements.cells(pages(spark, html)).collect()
    top = sorted((r["row_no"], r["cell_no"], r["text"], r["is_head"]) for r in got if r["outer_at"] is None)
    assert top == [(0, 0, "h", True), (0, 0, "z", False), (1, 0, "a b", False), (1, 1, "c", False)]
    below = sorted((r["row_no"], r["cell_no"], r["text"]) for r in got if r["outer_at"] is not None)
    assert below == sorted(2 * [(0, 0, "i1"), (0, 1, "i2 <b>"), (1, 0, "i3")])
    assert len({r["table_at"] for r in got}) == 4 and len({r["outer_at"] for r in got}) == 2


def test_reachable_follows_cycles_once(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(100, 101), (101, 100), (102, 102), (None, 1), (1, None)]
    starts = [0, 5, 100, 102, 777, None, 0]
    want = set()
    for s in {x for x in starts if x is not None}:
        seen, front, n = {s: 0}, {s}, 0
        while front:
            n += 1
            front = {b for a, b in edges if a in front and b is not None} - set(seen)
            seen |= dict.fromkeys(front, n)
        want |= {(s, node, k) for node, k in seen.items()}
    got = reachable(spark.createDataFrame([(s,) for s in starts], "start bigint"), spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert reachable(spark.createDataFrame([], "start bigint"), spark.createDataFrame(edges, "a bigint, b bigint")).count() == 0


def test_profiles_of_nested_entries(spark):
    profile = lambda n: f'<profile name="{n}" typeName="Ranged Weapons"><characteristics><characteristic name="Range">{n}&quot;</characteristic></characteristics></profile>'
    xml = f"""<catalogue><selectionEntry type="unit" id="u" name="Unit"><profiles>{profile("own")}</profiles><selectionEntries><selectionEntry type="model">
        <selectionEntryGroups><selectionEntryGroup><selectionEntries><selectionEntry><profiles>{profile("deep")}{profile("own")}</profiles></selectionEntry></selectionEntries></selectionEntryGroup></selectionEntryGroups>
        <entryLinks><entryLink targetId="s" name="x"/></entryLinks></selectionEntry></selectionEntries></selectionEntry>
        <selectionEntry type="unit" id="v" name="Sibling"></selectionEntry><selectionEntry type="unit" id="w" name="Armed"><profiles>{profile("armed")}</profiles></selectionEntry>
        <selectionEntry type="unit" id="h" name="Hidden" hidden="true"><profiles>{profile("hidden")}</profiles></selectionEntry>
        <selectionEntry type="upgrade" id="s"><profiles>{profile("shared")}</profiles><entryLinks><entryLink targetId="u"/></entryLinks></selectionEntry></catalogue>"""
    got = catalog.entry_profiles(spark.createDataFrame([(1, xml), (2, None)], "catalogue bigint, xml string"), ["Ranged Weapons"]).collect()
    assert sorted((r["unit"], r["name"], r["values"]["Range"]) for r in got) == [("Armed", "armed", 'armed"')] + [("Unit", n, f'{n}"') for n in ("deep", "own", "shared")]


def test_changed_members_of_large_sets(spark, monkeypatch):
    from lorespark.operators import hashtree

    rng = random.Random(8)
    # One group holds a hundred times the members of the others.
    before = [(g, f"m{rng.randrange(10**6)}") for g in [1] * 3000 + list(range(2, 32)) * 2] + [(7, None), (40, "x"), (40, "x")]
    after = [r for r in before if rng.random() > 0.004 and r[0] != 9] + [(1, "new"), (50, "first"), (50, None)]
    sides = [spark.createDataFrame(rows, "g int, name string") for rows in (before, after)]
    was, now = ({r for r in rows if r[1] is not None} for rows in (before, after))
    want = {(*r, "removed") for r in was - now} | {(*r, "added") for r in now - was}
    assert {tuple(r) for r in hashtree.changed_members(*sides, ["g"], "name").collect()} == want
    trees = [hashtree.member_tree(s, ["g"], "name") for s in sides]
    ranges = hashtree.changed_ranges(*trees, ["g"]).collect()
    assert len(ranges) <= len(want) and {r["g"] for r in ranges} == {g for g, *_ in want}
    assert hashtree.changed_members(sides[0], sides[0], ["g"], "name", (trees[0], trees[0])).count() == 0
    assert hashtree.changed_members(sides[0].limit(0), sides[1], ["g"], "name").count() == len(now)


def test_top_similar_equals_all_pairs_ranked(spark):
    from twins import dice

    from lorespark.operators.match import top_similar

    rng = random.Random(9)
    names = {" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(2)) for _ in range(60)}
    terms = {n[:-1] + rng.choice("xyz") for n in list(names)[:25]} | {"zz", ""}
    got = {}
    frames = [spark.createDataFrame([(x,) for x in side], f"{c} string") for side, c in ((terms, "term"), (names, "name"))]
    for r in top_similar(*frames, "term", "name", 4, 0.3).collect():
        got.setdefault(r["term"], []).append((r["rank"], round(r["score"], 9), r["name"]))
    for term in terms:
        best = sorted(((-round(dice(term, n), 9), n) for n in names if dice(term, n) >= 0.3))[:4]
        assert sorted(got.get(term, [])) == [(i, -s, n) for i, (s, n) in enumerate(best, 1)]


def brute_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_edits_of_patterns_anywhere_in_texts():
    rng = random.Random(2)
    word = lambda most, least=0: "".join(rng.choice("abcé ") for _ in range(rng.randint(least, most)))
    pairs = [(word(64, 1), word(90)) for _ in range(400)] + [("a", ""), ("x" * 64, "x" * 64)]
    got = approx.edits([p for p, _ in pairs], [t for _, t in pairs]).tolist()
    assert got == [brute_edits(p, t) for p, t in pairs]
    assert len(approx.edits([], [])) == 0


def test_approximate_search_misses_nothing(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 9)))
    names = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["x" * 40 + " tail", ""]
    asked = {n[:-1] + rng.choice("abz") for n in names[:40] if n} | {"x" * 39 + " tail", "zzzz", ""}
    items = spark.createDataFrame([("s", n, n.upper()[:12] or None) for n in names] + [("t", "abcde", None)], "scope string, name string, other string")
    queries = spark.createDataFrame([("s", q) for q in asked] + [("t", "abcd"), (None, "abcd"), ("s", None)], "scope string, q string")
    got = {(r["scope"], r["q"], r["name"]): r["score"] for r in approx.approximate_search(queries, items, "q", {"name": 0.7, "other": 0.3}, ["scope"]).collect()}

    def field(q, text):
        q, text = q.lower(), (text or "").lower()
        if not q or not text:
            return None
        if q == text:
            return 2.0**-52
        parts = [q[i : i + 32] for i in range(0, len(q), 32)]
        parts[-1] = q[-32:] if len(q) > 32 else parts[-1]
        each = [brute_edits(p, text) / len(p) for p in parts]
        if min(each) > 0.4 or not re.search("[" + re.escape(q) + "]{3}", text):
            return None
        return sum(max(e, 0.001) if e <= 0.4 else 1 for e in each) / len(each)

    want = {}
    for scope, q in [("s", q) for q in asked] + [("t", "abcd")]:
        for s, name, other in [("s", n, n.upper()[:12]) for n in names] + [("t", "abcde", None)]:
            told = [(w, field(q, x), x) for w, x in ((0.7, name), (0.3, other)) if s == scope]
            if any(f is not None for _, f, _ in told):
                score = 1.0
                for w, f, x in told:
                    score *= f ** (w * round(len(x.split()) ** -0.5, 3)) if f is not None else 1
                want[scope, q, name] = score
    assert got.keys() == want.keys() and len(want) > 60
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_phrases_leftmost_longest(spark):
    d = spark.createDataFrame([("new york", "NY"), ("York", "Y"), ("new york city", "NYC"), ("a.b", "dot"), ("İx", "dotted"), ("NEW YORK", "later"), ("", "none")], "phrase string, official string")
    texts = ["In New York City, york; newyork xa.b a.b a.bc", "new york new york citys", None, "", "É York_ York", "İx!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: [(h["start"], h["length"], h["official"]) for h in r["hits"]] for r in phrases.find_phrases(df, d, values=["official"]).collect()}
    assert got == {0: [(3, 13, "NYC"), (18, 4, "Y"), (37, 3, "dot")], 1: [(0, 8, "later"), (9, 8, "later")], 2: [], 3: [], 4: [(8, 4, "Y")], 5: [(0, 2, "dotted")]}
    new = {r["id"]: r["replaced"] for r in phrases.replace_phrases(df, d).collect()}
    assert new[0] == "In NYC, y; newyork xa.b dot a.bc" and new[2] is None and new[3] == ""
    tags = d.withColumn("kind", F.lit("place"))
    again = spark.createDataFrame([(0, "[PLACE:York] york nyc"), (1, "y [x]")], "id int, text string")
    assert [r["replaced"] for r in phrases.replace_phrases(again, tags, tag=True).orderBy("id").collect()] == ["[PLACE:York] [PLACE:Y] [PLACE:NYC]", "[PLACE:Y] [x]"]
    assert phrases.find_phrases(df, d.limit(0)).filter("size(hits) > 0").count() == 0


def test_fifty_thousand_phrases_cost_what_the_text_costs(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    many = [f"{word()} {word()} {i}" for i in range(50_000)]
    built = {n: phrases.automaton([(p,) for p in many[:n]], f"v{n}") for n in (500,)} | {50_000: phrases.automaton([(p,) for p in many], "all")}
    text = " ".join(rng.choice(many) for _ in range(20_000))
    took = {}
    for n, a in built.items():
        began = time.process_time()
        hits = len(list(phrases.spans(text, a)))
        took[n] = time.process_time() - began
    assert hits == 20_000 and took[50_000] < 10 * took[500] + 1
    monkeypatch.setattr(phrases, "MOST", 10)
    with pytest.raises(ValueError):
        phrases.find_phrases(spark.createDataFrame([("x",)], "text string"), spark.createDataFrame([("a long phrase",)], "phrase string"))


def test_walk_keeps_a_state_for_each_key(spark):
    rows = [(k, i, i % 7) for k in (1, 2, None) for i in range(500)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, at int, v int").repartition(5)
    got = walk(df, ["k"], ["at"], ["v"], lambda: 0, lambda s, r: (s + r[0], (s + r[0],) if r[0] else None), "sum bigint").collect()
    want = [(k, i, i % 7, sum(j % 7 for j in range(i + 1))) for k in (1, 2, None) for i in range(500) if i % 7]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert walk(df.limit(0), ["k"], ["at"], ["v"], lambda: 0, lambda s, r: (s, ()), "").count() == 0


def timed(make, sizes):
    took = []
    for n in sizes:
        df = make(n).cache()
        df.count()
        began = time.time()
        yield df
        took.append(time.time() - began)
        df.unpersist()
    assert took[1] < 5 * took[0] + 3


def test_one_key_with_four_times_the_rows(spark):
    """Folds over one key grow with its rows: 20,000 and 80,000 events of one game, words of one text, spans of one key."""
    kinds = ["next_phase", "unit_moved", "unit_shot", "end_turn", "score_points"]
    game = lambda n: spark.range(n).select(F.lit(1).alias("game_id"), F.col("id").cast("string").alias("id"), F.col("id").alias("ts"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % 5 + 1).cast("int")).alias("type"))
    for df in timed(game, (20_000, 80_000)):
        assert legal_events(df).count() > 1000
    text = lambda n: spark.range(1).select("id", F.repeat(F.lit("some words. "), n).alias("text"))
    for df in timed(text, (20_000, 80_000)):
        assert word_spans(df, ["id"], "text", 2).count() == 4 * df.select(F.length("text") / 12).first()[0] - 1
        assert text_chunks(df, "id", "text").count() > 20
    spans = lambda n: spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 1 + F.col("id") % 6).alias("end"))
    for df in timed(spans, (20_000, 80_000)):
        assert longest_spans(df, ["k"]).count() > 1000
        assert pack(df.withColumn("len", F.lit(10)), "k", "start", "len", 100).agg(F.max("chunk")).first()[0] == df.count() // 10 - 1


def test_longest_spans_equals_a_scan_of_all(spark):
    rng = random.Random(6)
    rows = list({(k, a, a + rng.randint(1, 9)) for k in range(3) for a in (rng.randrange(120) for _ in range(90))})
    want = set()
    for k, a, b in sorted(rows, key=lambda r: (r[0], r[1] - r[2], r[1])):
        if all(b <= x or a >= y for key, x, y in want if key == k):
            want.add((k, a, b))
    assert {tuple(r) for r in longest_spans(spark.createDataFrame(rows, "k int, start int, end int"), ["k"]).collect()} == want


def test_names_with_any_number_of_abilities(spark):
    known = ["blast", "heavy", "torrent", "pistol", "rapid fire"]
    names = ["Boltblastheavytorrentpistol", "Boltblastheavytorrentpistolrapidfire", "Plain gun", "Autopistol", "[BLAST] Gun heavy", "Gunheavyblast"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", weapon_name(F.col("n"), known, ["autopistol"]).alias("w"))
    got = {r["n"]: (r["w"]["name"], sorted(r["w"]["abilities"])) for r in df.collect()}
    assert got[names[0]] == ("Bolt", ["[BLAST]", "[HEAVY]", "[PISTOL]", "[TORRENT]"])
    assert got[names[1]] == ("Bolt", ["[BLAST]", "[HEAVY]", "[PISTOL]", "[RAPID FIRE]", "[TORRENT]"])
    assert got[names[2]] == ("Plain gun", []) and got[names[3]] == ("Autopistol", [])
    assert got[names[4]] == ("Gun heavy", ["[BLAST]"]) and got[names[5]] == ("Gun", ["[BLAST]", "[HEAVY]"])
