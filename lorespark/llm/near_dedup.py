"""MinHash near-dedup.

1. Every document gets a digest of its words, the size of its shingle set and
   a signature: the minima of 200 universal hashes over the set, 16 bits kept
   of each. Texts with equal words go on as one, under a number of their own
   (rep); doc_ids, which may be null or repeat, come back at the end only.
2. Signatures are cut into 40 bands of 5. Texts that agree in a band share a
   bucket. A pair of similarity 0.8 misses every band with a chance of 1e-7.
3. In each bucket every text is paired with the smallest one: as many pairs as
   texts. Pairs whose signatures agree well enough are confirmed on the full
   shingle sets, and the links make components.
4. Only buckets that still hold more than one component go on. Their texts are
   compared signature by signature in blocks of bounded size, pairs across
   components only, each pair in the first band that it shares; those that
   agree are confirmed on the full sets inside the block, until what is linked
   is joined. So no link is lost to the choice of a bucket's smallest text,
   and no group of copies is expanded into rows of pairs. Where a bucket holds
   more texts outside its largest component than a block, these are first cut
   by a second shared band, which joins most of what is alike; then the pairs
   that share no second band are compared too, block by block. So every pair
   that shares a band is compared, whatever the bucket's size; the size decides
   the order of the work only.
5. Components over all links, by large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import NO_ID, Scratch, attach, documents, groups_in_order, keep_rows, row_id, row_mark, sized
from lorespark.llm.components import components
from lorespark.llm.hashing import WordHashes, digest, mixed, runs

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: Signatures of texts of similarity 0.8 agree in 0.8 of the hashes, standard deviation 0.028; a pair goes on from 5 deviations below.
SLACK = 5.0
#: Texts of a block in step 4, and about so many texts to a block of full sets.
BLOCK, SET_BLOCK = 1024, 256

_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_set(hashes: WordHashes, words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of n words; with fewer words the whole is one."""
    if not words:
        return np.zeros(0, np.uint64)
    got = np.sort(runs(hashes.of(words), min(n, len(words))))
    if len(words) < n:
        got = mixed(got + np.uint64(len(words)))
    return got[np.append(True, got[1:] != got[:-1])]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of a * x + b mod 2^64 over the set, in blocks that fit the cache; 16 bits of each."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 128):
        np.minimum(low, (_A[:, None] * shingles[None, i : i + 128] + _B[:, None]).min(axis=1), out=low)
    return ((low >> np.uint64(8)) & np.uint64(0xFFFF)).astype("<u2")


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", row_id(F.col("doc_id")).alias("oid"), row_mark(F.col("text")).alias("mark"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _prepare(docs: DataFrame, n: int) -> DataFrame:
    """One row per document; spot tells rows with the same id and text apart."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part, d, sizes, signs = batch.slice(begin, 256), [], [], []
                for text in part["text"].to_pylist():
                    words = text.lower().split()
                    x = shingle_set(hashes, words, n)
                    d.append(digest(b" ".join(words)))
                    sizes.append(len(x))
                    signs.append(signature(x).tobytes() if len(x) else None)
                yield pa.record_batch({"doc_id": part["doc_id"], "oid": part["oid"], "mark": part["mark"], "spot": pa.array(range(begin, begin + len(d)), pa.int64()), "d1": pa.array([x for x, _ in d], pa.int64()), "d2": pa.array([y for _, y in d], pa.int64()), "n_shingles": pa.array(sizes, pa.int64()), "sig": pa.array(signs, pa.binary())})

    return texts_of(docs).mapInArrow(walk, "doc_id bigint, oid bigint, mark binary, spot bigint, d1 bigint, d2 bigint, n_shingles bigint, sig binary")


def _alike(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose signatures agree in enough places."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sign = [np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sig_a", "sig_b")]
            yield batch.select(["a", "b"]).filter(pa.array((sign[0] == sign[1]).mean(axis=1) >= least))

    return both.select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(walk, "a bigint, b bigint").distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(rep, set) of the wanted texts (rep, oid, mark), the set as sorted 64-bit hashes."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                yield pa.record_batch({"rep": part["rep"], "set": pa.array([shingle_set(hashes, t.lower().split(), n).tobytes() for t in part["text"].to_pylist()], pa.binary())})

    texts = texts_of(docs).select("oid", "mark", "text").join(sized(wanted), ["oid", "mark"])
    return texts.select("rep", "text").mapInArrow(walk, "rep bigint, set binary").groupBy("rep").agg(F.first("set").alias("set"))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y|, for sorted distinct hashes."""
    few, many = sorted((len(x), len(y)))
    if 100 * few < percent * many:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (few + many - both)


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Pairs (a, b) with 100 * |A and B| >= percent * |A or B|, on full sets.

    Texts are hashed into blocks and pairs go to their pair of blocks, so a
    text with many pairs is sent once to each block that it meets, not once
    with each pair.
    """
    pairs = scratch.write(pairs, f"{name}_pairs")
    ids = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(reps.select("rep", "oid", "mark"), "rep"), f"{name}_ids")
    n_blocks = max(1, ids.count() // SET_BLOCK)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks))
    placed = pairs.withColumns({"ba": block("a"), "bb": block("b")})
    need = placed.select(F.col("ba").alias("to_a"), F.col("bb").alias("to_b"), F.explode(F.array("a", "b")).alias("rep")).distinct()
    sent = need.join(full_sets(docs, ids, n), "rep")

    def confirm(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {rep: np.frombuffer(s, np.uint64) for rep, s in zip(right["rep"].to_pylist(), right["set"].to_pylist(), strict=True)}
        keep = [linked(sets[a], sets[b], percent) for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True)]
        return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return scratch.write(placed.groupBy("ba", "bb").cogroup(sent.groupBy("to_a", "to_b")).applyInArrow(confirm, "a bigint, b bigint"), name)


def _cut(wide: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (key, band, rep, component) of large buckets by each second band that texts of several components share: key, band, sub, rep, component, n.

    A pair is compared in the first two bands that it shares; pairs that share
    one band and no other are left to the pass after it.
    """
    later = wide.filter(F.col("band") < BANDS - 1).join(reps.select("rep", "sig"), "rep").withColumn("sub", F.explode(F.sequence(F.col("band") + 1, F.lit(BANDS - 1))))
    rows_of = F.substring("sig", F.col("sub") * (2 * ROWS) + 1, F.lit(2 * ROWS))
    cut = scratch.write(later.select(F.xxhash64("key", "sub", rows_of).alias("key"), "band", "sub", "rep", "component"), "cut")
    several = cut.groupBy("key", "sub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("key", "sub", "n")
    return cut.join(scratch.write(several, "cut_open"), ["key", "sub"])


def _across(rows: DataFrame, reps: DataFrame, comp: DataFrame, docs: DataFrame, n: int, percent: int, least: float, scratch: Scratch) -> DataFrame:
    """Links of step 4, enough of them to join what is linked: of one bucket, of different components.

    rows: key, band, rep, n (texts in the bucket). The first pass over the
    blocks keeps the texts that agree with any text of another component; only
    their full sets are sent to the second pass, which confirms. Both emit at
    most a row per text and block, however many pairs they compare. Buckets cut
    by a second band go through both passes once more for the pairs that have
    none, with the components that the first links make.
    """
    now = rows.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    open_ = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    members = now.join(open_.select("key", F.col("most.component").alias("most"), F.col("most.c").alias("n_most")), "key").withColumn("sub", F.lit(-1))
    members = scratch.write(members.select("key", "band", "sub", "rep", "n", "component", "most", "n_most"), "bucket_rows")
    wide = (F.col("component") != F.col("most")) & (F.col("n") - F.col("n_most") > BLOCK)
    # Texts of the bucket's largest component need no comparing among themselves: only the others are copied to all of its blocks.
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    largest, large, others = F.col("component") == F.col("most"), blocks(F.col("n_most")), blocks(F.col("n") - F.col("n_most"))
    mine = F.pmod(F.xxhash64("rep"), F.when(largest, large).otherwise(others).cast("bigint")).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda bi, bj: F.struct(bi.alias("bi"), bj.alias("bj"))
    # Cells (-1 - a, b): block a of the largest component with block b of the others. Cells (a, b): two blocks of the others.
    with_most = F.when(largest, F.transform(all_of(others), lambda b: cell(-1 - F.col("mine"), b))).otherwise(F.transform(all_of(large), lambda a: cell(-1 - a, F.col("mine"))))
    in_blocks = lambda n: F.transform(all_of(n), lambda o: cell(F.least("mine", o), F.greatest("mine", o)))
    among = F.when(largest | wide, F.array().cast("array<struct<bi:int,bj:int>>")).otherwise(in_blocks(others))
    placed = members.withColumns({"mine": mine, "largest": largest}).withColumn("cell", F.explode(F.concat(with_most, among)))
    cut_up = not members.filter(wide).isEmpty()
    if cut_up:
        parts = _cut(members.filter(wide).select("key", "band", "rep", "component"), reps, scratch).withColumn("largest", F.lit(False))
        parts = parts.withColumn("mine", F.pmod(F.xxhash64("rep"), blocks(F.col("n")).cast("bigint")).cast("int")).withColumn("cell", F.explode(in_blocks(blocks(F.col("n")))))
        both = ["key", "band", "sub", "rep", "component", "largest", "mine", "cell"]
        placed = placed.select(*both).unionByName(parts.select(*both))
    links = _compared(placed, False, reps, docs, n, percent, least, scratch, "more")
    if not cut_up:
        return links
    now = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links), scratch, "cut_comp")
    rest = members.filter(wide).withColumns({"largest": F.lit(False), "mine": mine}).withColumn("cell", F.explode(in_blocks(others)))
    rest = rest.drop("component").join(now.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return links.union(_compared(rest, True, reps, docs, n, percent, least, scratch, "rest"))


def _compared(placed: DataFrame, alone: bool, reps: DataFrame, docs: DataFrame, n: int, percent: int, least: float, scratch: Scratch, name: str) -> DataFrame:
    """Links inside the cells of placed (key, band, sub, rep, component, largest, mine, cell), between texts of different components.

    A pair counts in the first band, or the first two, that it shares; with
    ``alone`` if it shares the cell's band and no other.
    """
    cast = placed.join(reps.select("rep", "sig"), "rep").withColumns({"bi": F.col("cell.bi"), "bj": F.col("cell.bj")})
    shape = "key bigint, bi int, bj int, mine int, largest boolean, band int, sub int, rep bigint, component bigint, sig binary"
    columns = [c.split()[0] for c in shape.split(", ")]
    dealt = lambda df, *more: df.select(*columns, *more).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")

    def alike(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """Each text's index with those behind it that agree with it and first do so in this band."""
        comp, mine, largest = group["component"].to_numpy(), group["mine"].to_numpy(), group["largest"].to_numpy()
        sign = np.frombuffer(b"".join(group["sig"].to_pylist()), "<u2").reshape(-1, HASHES)
        band, sub, bi, bj = (group[c][0].as_py() for c in ("band", "sub", "bi", "bj"))
        for i in range(len(comp) - 1):
            ok = comp[i + 1 :] != comp[i]
            if bi < 0:
                ok &= largest[i + 1 :] != largest[i]
            elif bi != bj:
                ok &= mine[i + 1 :] != mine[i]
            j = np.flatnonzero(ok) + i + 1
            if len(j):
                same = sign[j] == sign[i]
                close = same.mean(axis=1) >= least
                shared = same[close].reshape(-1, BANDS, ROWS).all(axis=2)
                here = shared.argmax(axis=1) == band
                if alone:
                    here = shared[:, band] & (shared.sum(axis=1) == 1)
                elif sub >= 0:
                    shared[:, band] = False
                    here &= shared.argmax(axis=1) == sub
                yield i, j[close][here]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, ["key", "bi", "bj"]):
            active = np.zeros(group.num_rows, bool)
            for i, j in alike(group):
                active[j] = True
                active[i] |= len(j) > 0
            if active.any():
                yield from group.filter(pa.array(active)).to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, ["key", "bi", "bj"]):
            rep, comp = group["rep"].to_pylist(), group["component"].to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in group["set"].to_pylist()]
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while x in up:
                    x = up[x]
                return x

            links = []
            for i, others in alike(group):
                for j in others.tolist():
                    a, b = root(comp[i]), root(comp[j])
                    if a == b or not linked(sets[i], sets[j], percent):
                        continue
                    up[a] = b
                    links.append((rep[i], rep[j]))
            if links:
                yield pa.record_batch({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    active = scratch.write(dealt(cast).mapInArrow(find, shape), f"{name}_active")
    ids = scratch.write(active.select("rep").distinct().join(reps.select("rep", "oid", "mark"), "rep"), f"{name}_active_ids")
    return scratch.write(dealt(active.join(full_sets(docs, ids, n), "rep"), "set").mapInArrow(confirm, "a bigint, b bigint"), f"{name}_links")


def judged_rows(told: DataFrame, reps: DataFrame, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents with n_shingles, component_id, kept, oid and mark: what the components of texts (node, component) say of each row of told.

    told: doc_id, oid, mark, spot, d1, d2, n_shingles. reps: rep, d1, d2, oid, mark, copies of distinct texts.
    """
    who = F.struct("oid", "mark")
    # The smallest (doc_id, mark) of a component, its own smallest text among them, stands for it.
    nodes = comp.select(F.col("node").alias("rep"), "component").union(comp.select(F.col("component").alias("rep"), "component").distinct())
    named = scratch.write(nodes.join(reps.select("rep", "d1", "d2", "oid", "mark"), "rep"), "named")
    heads = named.groupBy("component").agg(F.min(who).alias("head"))
    linked = attach(named, heads, ["component"], "rep").select("d1", "d2", "head")
    # Only texts with copies or links have anything to say; a text alone is its own component.
    copied = reps.filter("copies").select("d1", "d2", who.alias("head"))
    said = scratch.write(linked.union(copied).groupBy("d1", "d2").agg(F.min("head").alias("head")), "said")
    joined = attach(told, said, ["d1", "d2"], "spot")
    alone = (F.col("n_shingles") == 0) | F.col("head").isNull()
    comp_id = F.when(alone, F.col("oid")).otherwise(F.col("head.oid"))
    kept = alone | (F.col("head") == who)
    return joined.select("doc_id", "n_shingles", F.nullif(comp_id, F.lit(NO_ID)).alias("component_id"), kept.alias("kept"), "oid", "mark")


def _judged(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Rows of near_dedup() with oid and mark, by which a row is found again."""
    scratch = Scratch(docs.sparkSession, "near_dedup")
    least = percent / 100 - SLACK * (0.16 / HASHES) ** 0.5
    told = scratch.write(_prepare(docs, shingle_words), "told")
    who = F.struct("oid", "mark")
    groups = told.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min(who).alias("lo"), F.max(who).alias("hi"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    # Numbers are given once, as the table is written.
    reps = scratch.write(groups.select(F.monotonically_increasing_id().alias("rep"), "d1", "d2", "lo.oid", "lo.mark", (F.col("lo") < F.col("hi")).alias("copies"), "n_shingles", "sig"), "reps")

    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("sig", 1 + 2 * ROWS * i, 2 * ROWS)).alias("key")) for i in range(BANDS)])
    entries = reps.select("rep", F.explode(bands).alias("e")).select("rep", "e.band", "e.key")
    shared = entries.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = scratch.write(entries.join(shared, "key"), "rows")

    stars = rows.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = confirmed(_alike(stars, reps, least), reps, docs, shingle_words, percent, scratch, "star_links")
    comp = components(links, scratch, "star_comp")
    more = _across(rows, reps, comp, docs, shingle_words, percent, least, scratch)
    if not more.isEmpty():
        comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch, "comp")

    return judged_rows(told, reps, comp, scratch)


def near_dedup(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are those of the whole text with A-Z in lower case, between ASCII
    white space. Documents are linked when 100 * intersection >= percent *
    union of their sets of shingles. Without words or text a document has no
    shingle and no link. A null doc_id counts as larger than any other and is
    its own component_id (null) unless linked to a smaller one. Every text is
    judged for itself: rows that share a doc_id, or have none, are linked only
    if their texts are, and of those the one with the smallest MD5 is kept.
    Rows that repeat doc_id and text get one verdict. Texts of any length go
    whole; other columns are not looked at, whatever their names; empty docs
    give an empty result.
    """
    return _judged(docs, shingle_words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one row of each component, with their columns unchanged, whatever their names; links as in near_dedup().

    Of rows that repeat doc_id and text one stays, any of them; those without
    words all stay. Empty docs give an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near_dropped")
    judged = _judged(docs, shingle_words, percent).select(F.col("oid").alias("_oid"), F.col("mark").alias("_mark"), "kept", (F.col("n_shingles") > 0).alias("once"))
    return keep_rows(docs, scratch.write(judged, "judged"), scratch)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), shingle_words=4)
