"""N-gram Jaccard join by signature trees.

1. Every document gets a digest of its words, the size of its shingle set and
   a bitmap of its shingles, two to four bits a shingle. Texts with equal
   words go on as one.
2. Shingles are put in one order for all texts: by hash, those that very many
   texts hold last. Two sets with 100 * intersection >= percent * union share
   a shingle among the first n - ceil(n * percent / 100) + 1 of both, so each
   text is sent to the groups of these first shingles only. They travel packed,
   a block of texts at a time; shingles held by very many are spread over all
   tasks and grouped with partial sums. Groups of equal members are one.
3. In each group every text is paired with the smallest one; pairs that pass
   the bound of step 4 are confirmed on full sets, and links make components.
4. Groups with texts of several components build signature trees: the leaves
   are the texts in order of size, a node holds the OR of its children's
   bitmaps, the range of their sizes and of their components. Two trees are
   walked together from the roots down; a pair of nodes goes no further if it
   lies in one component, if the sizes differ by too much, or if the bits that
   both have, with what the bitmaps may hide, are too few for the least overlap
   that the sizes ask for. Pairs of leaves are held to the tighter bound of the
   bits that one has and the other has not. The pairs left are confirmed on
   full sets; where a group leaves more pairs than a few a text, they are not
   listed: its texts go to a second walk with their full sets, which links them.
5. Components over all links, by large-star and small-star.

Nothing is lost: step 2 holds for every pair that is alike enough, and the
bounds of step 4 are never below the true overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, attach, documents, groups_in_order, sized
from lorespark.llm.components import components
from lorespark.llm.hashing import WordHashes, digest, mixed
from lorespark.llm.near_dedup import confirmed, linked, shingle_set, texts_of, full_sets, judged_rows

#: Shingles of a block of texts that is packed together, and first shingles of a part that is grouped at once.
BLOCK, PART = 500_000, 1_000_000
#: A shingle counts as held by very many from so many texts on, or from more on, so that there are HEAVY such shingles at most.
MANY, HEAVY = 20, 1_000_000
#: Digests of texts that a task remembers, so as to send copies once.
SEEN = 200_000
#: Texts of a group in a cell, children of a node, and bytes of bitmaps that are compared at once.
CELL, FAN, CHUNK = 1024, 8, 8 << 20
#: Pairs that a cell may list, for each of its texts.
LISTED = 4


def n_first(n: np.ndarray | int, percent: int):
    """How many of a set's first shingles hold one of those of any set that is alike enough."""
    return n + (-n * percent) // 100 + 1


def width(n: int) -> int:
    """Bits of the bitmap of a set: the power of two from 2 n on, 64 at least."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(shingles: np.ndarray) -> bytes:
    bits = np.zeros(width(len(shingles)), np.uint8)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _prepare(docs: DataFrame, n: int) -> DataFrame:
    """One row per document; the first of each block of rows also lists shingles that several of its texts hold, with how many do."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part, d, sizes, maps, sets = batch.slice(begin, 4096), [], [], [], {}
                for text in part["text"].to_pylist():
                    words = text.lower().split()
                    x = shingle_set(hashes, words, n)
                    d.append(digest(b" ".join(words)))
                    sizes.append(len(x))
                    maps.append(bitmap(x) if len(x) else None)
                    sets[d[-1]] = x
                held, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                often = np.flatnonzero(times > 1)
                shared = np.stack([held[often].view(np.int64), times[often]]).tobytes() if len(often) else None
                yield pa.record_batch(
                    {"doc_id": part["doc_id"], "oid": part["oid"], "mark": part["mark"], "spot": pa.array(range(begin, begin + len(d)), pa.int64()), "d1": pa.array([x for x, _ in d], pa.int64()), "d2": pa.array([y for _, y in d], pa.int64())}
                    | {"n_shingles": pa.array(sizes, pa.int64()), "bits": pa.array(maps, pa.binary()), "shared": pa.array([shared] + [None] * (len(d) - 1), pa.binary())}
                )

    return texts_of(docs).mapInArrow(walk, "doc_id bigint, oid bigint, mark binary, spot bigint, d1 bigint, d2 bigint, n_shingles bigint, bits binary, shared binary")


def _heavy(told: DataFrame, scratch: Scratch) -> np.ndarray:
    """Shingles that very many texts hold, HEAVY at most: which ones only decides the order, so what blocks of texts know of them is enough."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch["shared"]:
                token, n = np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1)
                yield pa.record_batch({"token": pa.array(token), "n": pa.array(n)})

    counts = told.select("shared").filter("shared is not null").mapInArrow(walk, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= MANY)
    counts = scratch.write(counts.withColumn("power", F.floor(F.log2("n")).cast("int")), "often")
    # From which power of two on there are HEAVY of them at most: 63 powers.
    least, total = 0, 0
    for power, n in sorted(map(tuple, counts.groupBy("power").agg(F.count(F.lit(1))).collect()), reverse=True):
        total += n
        if total > HEAVY:
            least = power + 1
            break
    return np.sort(counts.filter(F.col("power") >= least).select("token").toArrow()["token"].to_numpy().view(np.uint64))


def _packed(docs: DataFrame, n: int, percent: int, heavy: np.ndarray, n_parts: int) -> DataFrame:
    """First shingles of all texts in packed rows: part, tokens (uint64), who (uint32 places in d1 and d2, the texts' digests).

    Parts from n_parts on hold shingles of ``heavy``, in any of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, heavy = WordHashes(), set(), shared.value
        ids: list[tuple[int, int]] = []
        firsts: list[np.ndarray] = []
        much: list[np.ndarray] = []
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            tokens, late = np.concatenate(firsts), np.concatenate(much)
            who = np.repeat(np.arange(len(firsts), dtype=np.uint32), [len(x) for x in firsts])
            # Any part will do for heavy ones: by the text, so that they are spread.
            part = np.where(late, n_parts + (who + held) % n_parts, (tokens >> np.uint64(20)) % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            tokens, who, part = tokens[order], who[order], part[order]
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            d = np.array(ids, np.int64)
            out = []
            for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
                # Places ascend within a part.
                here = who[a:b]
                fresh = np.append(True, here[1:] != here[:-1])
                used, place = here[fresh], np.cumsum(fresh) - 1
                out.append((int(part[a]), tokens[a:b].tobytes(), place.astype("<u4").tobytes(), d[used, 0].tobytes(), d[used, 1].tobytes()))
            kinds = [pa.int32(), *[pa.binary()] * 4]
            for i in range(0, len(out), 512):
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out[i : i + 512], strict=True), kinds, strict=True)], names=["part", "tokens", "who", "d1", "d2"])

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                for text in batch.slice(begin, 256)["text"].to_pylist():
                    words = text.lower().split()
                    d = digest(b" ".join(words))
                    if not words or d in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                    x = shingle_set(hashes, words, n)
                    k = int(n_first(len(x), percent))
                    late = heavy[np.minimum(np.searchsorted(heavy, x), len(heavy) - 1)] == x if len(heavy) else np.zeros(len(x), bool)
                    if late.any():
                        x, late = np.concatenate([x[~late], x[late]]), np.sort(late)
                    ids.append(d)
                    firsts.append(x[:k])
                    much.append(late[:k])
                    held += k
                    if held >= BLOCK:
                        yield from rows()
                        ids, firsts, much, held = [], [], [], 0
        if firsts:
            yield from rows()

    return texts_of(docs).select("text").mapInArrow(walk, "part int, tokens binary, who binary, d1 binary, d2 binary")


def _met(packed: DataFrame, n_parts: int) -> DataFrame:
    """(heavy, k1, k2, d1, d2): the texts of each shingle that several hold; k1, k2 tell sets of members apart.

    Of shingles held by very many, every text is listed, with the shingle as k1.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, ["part"]):
            tokens, d1, d2 = [], [], []
            for row in group.select(["tokens", "who", "d1", "d2"]).to_pylist():
                who = np.frombuffer(row["who"], "<u4")
                tokens.append(np.frombuffer(row["tokens"], np.uint64))
                d1.append(np.frombuffer(row["d1"], np.int64)[who])
                d2.append(np.frombuffer(row["d2"], np.int64)[who])
            token, d1, d2 = (np.concatenate(x) for x in (tokens, d1, d2))
            order = np.lexsort((d2, d1, token))
            token, d1, d2 = token[order], d1[order], d2[order]
            fresh = np.append(True, (token[1:] != token[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))
            token, d1, d2 = token[fresh], d1[fresh], d2[fresh]
            heavy = group["part"][0].as_py() >= n_parts
            if heavy:
                k1, k2 = token.view(np.int64), np.zeros(len(token), np.int64)
            else:
                starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
                size = np.diff(np.append(starts, len(token)))
                one = mixed(d1.view(np.uint64) + mixed(d2.view(np.uint64)))
                sums = [np.add.reduceat(x, starts).view(np.int64) for x in (one, mixed(one + np.uint64(1)))]
                # Of the shingles with the same texts one is enough.
                _, first = np.unique(np.stack([*sums, size], axis=1), axis=0, return_index=True)
                chosen = np.zeros(len(starts), bool)
                chosen[first] = True
                chosen &= size > 1
                rows = np.repeat(chosen, size)
                k1, k2 = (np.repeat(x, size)[rows] for x in sums)
                d1, d2 = d1[rows], d2[rows]
            for i in range(0, len(k1), 50_000):
                cut = slice(i, i + 50_000)
                yield pa.record_batch({"heavy": pa.array(np.full(len(k1[cut]), heavy)), "k1": pa.array(k1[cut]), "k2": pa.array(k2[cut]), "d1": pa.array(d1[cut]), "d2": pa.array(d2[cut])})

    dealt = packed.repartition(n_parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(walk, "heavy boolean, k1 bigint, k2 bigint, d1 bigint, d2 bigint")


def _rows(met: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(k1, k2, rep, hub, n) of groups of two texts or more, each set of members once."""
    named = scratch.write(met.distinct().join(reps.select("rep", "d1", "d2"), ["d1", "d2"]).select("heavy", "k1", "k2", "rep"), "named_rows")
    many = named.filter("heavy")
    sums = many.groupBy("k1").agg(F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(38,0)")).alias("s2"))
    keyed = attach(many.select("k1", "rep"), scratch.write(sums.select("k1", F.xxhash64("s1", "s2").alias("g1"), F.xxhash64("s2", "s1").alias("g2")), "heavy_keys"), ["k1"], "rep", "inner")
    rows = named.filter("not heavy").select("k1", "k2", "rep").union(keyed.select(F.col("g1").alias("k1"), F.col("g2").alias("k2"), "rep")).distinct()
    rows = scratch.write(rows, "rows")
    groups = scratch.write(rows.groupBy("k1", "k2").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    return scratch.write(rows.join(groups, ["k1", "k2"]), "grouped")


def too_far(lo_a, hi_a, lo_b, hi_b, overlap, percent: int) -> np.ndarray:
    """Whether no set of one size range is alike enough to one of the other, their overlap being at most ``overlap``."""
    apart = (100 * hi_a < percent * lo_b) | (100 * hi_b < percent * lo_a)
    return apart | ((100 + percent) * np.minimum(overlap, np.minimum(hi_a, hi_b)) < percent * (lo_a + lo_b))


def leaf_overlap(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most that two sets can share: each bit that only one has stands for a shingle that the other lacks."""
    only = lambda x, y: np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
    return np.minimum(n_a - only(bits_a, bits_b), n_b - only(bits_b, bits_a))


class Tree:
    """A signature tree over texts of one bitmap width: per level the OR of bitmaps, the range of sizes and of components, and the most shingles that a bitmap hides."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, comp: np.ndarray, row: np.ndarray):
        order = np.lexsort((row, comp, n))
        bits, n, comp, self.row = bits[order], n[order], comp[order], row[order]
        level = (bits, n, n, n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), comp, comp)
        self.levels = [level]
        while len(self.levels[-1][0]) > FAN:
            starts = np.arange(0, len(self.levels[-1][0]), FAN)
            self.levels.append(tuple(how.reduceat(x, starts, axis=0) for how, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), self.levels[-1], strict=True)))

    def pairs_with(self, other: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (of self, of other) of the pairs of leaves, of different components, that the bounds leave; other may be self."""
        alone, top = other is self, min(len(self.levels), len(other.levels)) - 1
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(self.levels[top][0])), np.arange(len(other.levels[top][0])), indexing="ij"))
        step = max(1, CHUNK // self.levels[0][0][0].nbytes)
        todo = [(top, a, b)]
        while todo:
            level, a, b = todo.pop()
            if alone:
                a, b = (x[a <= b] for x in (a, b)) if level else (x[a < b] for x in (a, b))
            if len(a) > step:
                todo += [(level, a[i : i + step], b[i : i + step]) for i in range(0, len(a), step)]
                continue
            (bits_a, lo_a, hi_a, hid_a, c_a, d_a), (bits_b, lo_b, hi_b, hid_b, c_b, d_b) = ([x[i] for x in t.levels[level]] for t, i in ((self, a), (other, b)))
            both = leaf_overlap(bits_a, bits_b, lo_a, lo_b) if not level else np.bitwise_count(bits_a & bits_b).sum(axis=1, dtype=np.int64) + np.minimum(hid_a, hid_b)
            one = (c_a == d_a) & (c_b == d_b) & (c_a == c_b)
            open_ = ~(one | too_far(lo_a, hi_a, lo_b, hi_b, both, percent))
            a, b = a[open_], b[open_]
            if not len(a):
                continue
            if not level:
                yield self.row[a], other.row[b]
                continue
            below = len(self.levels[level - 1][0]), len(other.levels[level - 1][0])
            i, j = (x.ravel() for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
            a, b = (FAN * a[:, None] + i).ravel(), (FAN * b[:, None] + j).ravel()
            there = (a < below[0]) & (b < below[1])
            todo.append((level - 1, a[there], b[there]))


def _folded(bits: list[bytes], wide: int) -> np.ndarray:
    """Bitmaps of at least ``wide`` bits as rows of that many, longer ones folded onto themselves."""
    return np.stack([np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, wide // 64), axis=0) for x in bits])


def cell_pairs(group: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a cell that the trees leave: of its one block, or of one block with the other.

    Sets that are alike enough have bitmaps of one width or of neighbouring
    ones; trees are built for each width, those of the next one folded.
    """
    n, comp, mine = (group[c].to_numpy() for c in ("n_shingles", "component", "mine"))
    bits, wide = group["bits"].to_pylist(), np.array([8 * len(x) for x in group["bits"].to_pylist()])
    two = group["bi"][0].as_py() != group["bj"][0].as_py()
    blocks = [np.flatnonzero(mine == m) for m in ((group["bi"][0].as_py(), group["bj"][0].as_py()) if two else (group["bi"][0].as_py(),))]

    def tree(rows: np.ndarray, w: int) -> Tree:
        return Tree(_folded([bits[i] for i in rows.tolist()], w), n[rows], comp[rows], rows)

    for w in np.unique(wide).tolist():
        here = [x[wide[x] == w] for x in blocks]
        # percent may allow sets of very different sizes: all wider bitmaps that can still meet.
        for v in [v for v in np.unique(wide).tolist() if v >= w and 100 * w * 2 >= percent * v // 2]:
            there = [x[wide[x] == v] for x in blocks]
            for k, x in enumerate(here):
                y = there[-1 - k]
                if not len(x) or not len(y) or (v == w and k):
                    continue
                left = tree(x, w)
                yield from left.pairs_with(left if v == w and not two else tree(y, w), percent)


CELLS = "k1 bigint, k2 bigint, bi int, bj int, mine int, rep bigint, component bigint, n_shingles bigint, bits binary"


def _by_trees(rows: DataFrame, signs: DataFrame, comp: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links of step 4, enough of them to join what is linked: of one group, of different components.

    Groups of two have been compared in step 3. Larger ones are cut into cells
    of two blocks, a text going to as many cells as there are blocks. The first
    walk lists the pairs that the bounds leave, which are then confirmed, each
    once; of a cell with more than LISTED a text it keeps the texts instead,
    and a second walk, with their full sets, links what is not joined yet. So
    the rows of each step are a bounded number for each text and cell.
    """
    now = rows.filter("n > 2").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    now = scratch.write(now.select("k1", "k2", "rep", "component", "n"), "open_rows")
    open_ = scratch.write(now.groupBy("k1", "k2").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("k1", "k2"), "open")
    blocks = F.ceil(F.col("n") / F.lit(CELL)).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks.cast("bigint")).cast("int")
    members = now.join(open_, ["k1", "k2"]).join(signs, "rep").withColumn("mine", mine)
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least("mine", o).alias("bi"), F.greatest("mine", o).alias("bj")))
    cast = members.withColumn("cell", F.explode(others)).withColumns({"bi": F.col("cell.bi"), "bj": F.col("cell.bj")})
    columns, by = [c.split()[0] for c in CELLS.split(", ")], ["k1", "k2", "bi", "bj"]
    dealt = lambda df, *more: df.select(*columns, *more).repartition(*by).sortWithinPartitions(*by)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, by):
            active, listed, n = np.zeros(group.num_rows, bool), [], 0
            for a, b in cell_pairs(group, percent):
                active[a] = active[b] = True
                n += len(a)
                if n <= LISTED * group.num_rows:
                    listed.append((a, b))
            if 0 < n <= LISTED * group.num_rows:
                rep = group["rep"].to_numpy()
                a, b = (rep[np.concatenate(x)] for x in zip(*listed, strict=True))
                none = {c: pa.nulls(n, group.schema.field(c).type) for c in columns}
                yield pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))} | none)
            elif n:
                kept = group.select(columns).filter(pa.array(active))
                for batch in kept.combine_chunks().to_batches():
                    none = pa.nulls(batch.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, *batch.columns], names=["a", "b", *columns])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, by):
            rep, comp = group["rep"].to_pylist(), group["component"].to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in group["set"].to_pylist()]
            up: dict[int, int] = {}

            def root(x: int, up: dict[int, int] = up) -> int:
                while x in up:
                    x = up[x]
                return x

            links = []
            for left, right in cell_pairs(group, percent):
                for i, j in zip(left.tolist(), right.tolist(), strict=True):
                    a, b = root(comp[i]), root(comp[j])
                    if a != b and linked(sets[i], sets[j], percent):
                        up[a] = b
                        links.append((rep[i], rep[j]))
            if links:
                yield pa.record_batch({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    found = scratch.write(dealt(cast).mapInArrow(find, f"a bigint, b bigint, {CELLS}"), "found")
    few = confirmed(found.filter("a is not null").select("a", "b").distinct(), reps, docs, n, percent, scratch, "few_links")
    active = found.filter("a is null").drop("a", "b")
    if active.isEmpty():
        return few
    ids = scratch.write(active.select("rep").distinct().join(reps.select("rep", "oid", "mark"), "rep"), "active_ids")
    return few.union(scratch.write(dealt(active.join(full_sets(docs, ids, n), "rep"), "set").mapInArrow(confirm, "a bigint, b bigint"), "more_links"))


def _near(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the bound of two leaves leaves."""
    side = lambda x: signs.select(F.col("rep").alias(x), F.col("bits").alias(f"bits_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    few, many = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    both = pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * few >= percent * many)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(batch["bits_a"], batch["bits_b"], batch["n_a"].to_pylist(), batch["n_b"].to_pylist(), strict=True):
                x, y = x.as_py(), y.as_py()
                w = 8 * min(len(x), len(y))
                most = leaf_overlap(_folded([x], w), _folded([y], w), np.array([n]), np.array([m]))
                keep.append(not too_far(n, n, m, m, most, percent)[0])
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(walk, "a bigint, b bigint")


def jaccard_join(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are those of the whole text with A-Z in lower case, between ASCII
    white space; a set holds the distinct shingles, or the whole sequence where
    there are fewer words. Documents are linked when 100 * intersection >=
    percent * union; without words or text a document has no shingle and no
    link. component_id is the smallest doc_id reachable by links. A null
    doc_id counts as larger than any other and is its own component_id (null)
    unless linked to a smaller one; rows that share a doc_id are linked only if
    their texts are. Repeated rows give repeated rows. Texts of any length go
    whole; other columns are not looked at, whatever their names; empty docs
    give an empty result.
    """
    scratch = Scratch(docs.sparkSession, "jaccard_join")
    told = scratch.write(_prepare(docs, shingle_words), "told")
    who = F.struct("oid", "mark")
    groups = told.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min(who).alias("lo"), F.max(who).alias("hi"), F.first("n_shingles").alias("n_shingles"))
    # Numbers are given once, as the table is written.
    reps = scratch.write(groups.select(F.monotonically_increasing_id().alias("rep"), "d1", "d2", "lo.oid", "lo.mark", (F.col("lo") < F.col("hi")).alias("copies"), "n_shingles"), "reps")
    n = F.col("n_shingles")
    first = n - F.ceil(n * percent / 100) + 1
    n_parts = int(reps.agg(F.coalesce(F.sum(first), F.lit(0))).first()[0]) // PART + 1

    met = scratch.write(_met(_packed(docs, shingle_words, percent, _heavy(told, scratch), n_parts), n_parts), "met")
    rows = _rows(met, reps, scratch)
    named = scratch.write(rows.select("rep").distinct().join(reps.select("rep", "d1", "d2", "n_shingles"), "rep"), "met_reps")
    signs = scratch.write(told.select("d1", "d2", "bits").join(sized(named.select("rep", "d1", "d2")), ["d1", "d2"]).groupBy("rep").agg(F.first("bits").alias("bits")).join(named.select("rep", "n_shingles"), "rep"), "signs")

    stars = scratch.write(rows.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = confirmed(_near(stars, signs, percent), reps, docs, shingle_words, percent, scratch, "star_links")
    comp = components(links, scratch, "star_comp")
    more = _by_trees(rows, signs, comp, reps, docs, shingle_words, percent, scratch)
    if not more.isEmpty():
        comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch, "comp")
    return judged_rows(told, reps, comp, scratch).select("doc_id", "n_shingles", "component_id")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))
