"""Token counts that follow edits.

A document's pre-tokens are packed into leaves of a segment tree whose nodes
hold sums of characters and tokens. An edit finds its leaf by descending the
character sums. The text is split again from a leaf boundary before the edit,
with two characters of context at least, up to the first leaf boundary behind
it that the new splitting meets again: from there on every pre-token is what
it was. Only that region is encoded; the sums on its paths to the root change.

Trees are kept as a table (the text with the sums of its leaves), which a batch
of edits turns into the next one: a tree is put together again from its leaves
without splitting or encoding anything, and documents without edits are handed
on as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, attach, documents

#: Pre-tokens in a leaf when a tree is built; a leaf that grows to GROWN times that is split by building the tree again.
LEAF, GROWN = 32, 16
CACHE = 300_000

EDITS = "array<struct<pos: int, n_delete: int, insert: string>>"
#: A table of trees: n_tokens is the sum at the root; chars, tokens and pieces are those of the leaves.
TREES = "doc_id bigint, text string, n_tokens bigint, chars array<int>, tokens array<int>, pieces array<int>"
EDITED = f"{TREES}, n_tokens_before bigint, n_edits int, n_pieces_reencoded bigint"


@lru_cache(4)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class Counter(dict):
    """Pre-token -> its number of tokens, of a tokenizer given as ranks."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # White space as the tokenizer's own regular expressions understand it.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[piece] = n = len(self.coder.encode_ordinary(piece))
        return n


class CountTree:
    """Segment tree over the leaves of one text; node 1 is the root, node i has children 2i and 2i + 1."""

    def __init__(self, count: Counter, text: str, leaves: tuple[list[int], list[int], list[int]] | None = None):
        """Of a text, or of a text and the characters, tokens and pieces of its leaves as leaves() gave them."""
        self.count = count
        self.reencoded = 0
        if leaves is None:
            self._build(text)
        else:
            self.text = text
            self._from_leaves(*leaves)

    def leaves(self) -> tuple[list[int], list[int], list[int]]:
        """Characters, tokens and pieces of the leaves that hold any; the first one always."""
        held = [i for i in range(self.m, 2 * self.m) if self.pieces[i]] or [self.m]
        return tuple([x[i] for i in held] for x in (self.chars, self.tokens, self.pieces))

    def _from_leaves(self, *leaves: list[int]) -> None:
        self.m = 1 << (len(leaves[0]) - 1).bit_length()
        self.chars, self.tokens, self.pieces = ([0] * self.m + x + [0] * (self.m - len(x)) for x in leaves)
        for i in range(self.m - 1, 0, -1):
            self._sum(i)

    def _build(self, text: str) -> None:
        self.text = text
        pieces = self.count.pattern.findall(text)
        parts = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self._from_leaves([sum(map(len, p)) for p in parts], [sum(map(self.count.__getitem__, p)) for p in parts], [len(p) for p in parts])

    def _sum(self, i: int) -> None:
        for x in (self.chars, self.tokens, self.pieces):
            x[i] = x[2 * i] + x[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf that holds a character position, and where it starts."""
        i, start = 1, 0
        while i < self.m:
            i *= 2
            if pos >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.m, start

    def edit(self, pos: int, n_delete: int, insert: str) -> None:
        """Replace n_delete characters at pos; positions beyond the text are moved to its end."""
        size = len(self.text)
        pos = min(max(pos, 0), size)
        end = min(pos + max(n_delete, 0), size)
        first, start = self._leaf_at(max(pos - 2, 0))
        if start > pos - 2 and first:
            first, start = self._leaf_at(max(start - 1, 0))
        self.text = self.text[:pos] + insert + self.text[end:]
        shift = len(insert) - (end - pos)
        # Old leaf boundaries behind the edit, where they are now.
        last, edge = self._leaf_at(end)
        edge += self.chars[self.m + last]
        last += 1
        at, n_tokens, n_pieces = start, 0, 0
        while True:
            while last < self.m and edge + shift < at:
                edge += self.chars[self.m + last]
                last += 1
            if at >= edge + shift and (at == edge + shift or last >= self.m) and at >= pos + len(insert):
                break
            m = self.count.pattern.match(self.text, at)
            if m is None:
                break
            at = m.end()
            n_tokens += self.count[m[0]]
            n_pieces += 1
        self.reencoded += n_pieces
        touched = range(first, min(last, self.m))
        for leaf in touched:
            here = leaf == first
            self.chars[self.m + leaf], self.tokens[self.m + leaf], self.pieces[self.m + leaf] = (at - start, n_tokens, n_pieces) if here else (0, 0, 0)
        nodes = {(self.m + leaf) // 2 for leaf in touched}
        while nodes - {0}:
            for i in sorted(nodes, reverse=True):
                self._sum(i)
            nodes = {i // 2 for i in nodes} - {0}
        if n_pieces > GROWN * LEAF:
            self._build(self.text)
            self.reencoded += self.pieces[1]


def _rows(schema: str, batches: Iterator[pa.RecordBatch], row) -> Iterator[pa.RecordBatch]:
    """Batches of what row() makes of each row, few texts at a time."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    for batch in batches:
        for begin in range(0, batch.num_rows, 128):
            part = batch.slice(begin, 128)
            rows = [row(*values) for values in zip(*(part[c].to_pylist() for c in part.schema.names), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.types, strict=True)], schema=fields)


def build_trees(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document, its tree (TREES).

    A null text is empty; a null doc_id stays null; texts of any length are
    counted whole. Repeated rows give repeated rows; other columns are left
    out, whatever their names; empty docs give an empty table.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks_path, pattern)

        def row(doc_id, text):
            tree = CountTree(count, text or "")
            return doc_id, tree.text, tree.n_tokens, *tree.leaves()

        yield from _rows(TREES, batches, row)

    return docs.select("doc_id", "text").mapInArrow(walk, TREES)


def edit_trees(trees: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The trees (EDITED) after the edits in column ``edits`` (EDITS, in order; each position is one of the text as the edits before it left it).

    Null edits are none, and such a tree is handed on untouched; a null insert
    is empty; positions outside the text are moved to its end. Repeated rows
    are edited each for itself; texts of any length go whole; other columns are
    left out, whatever their names; empty trees give an empty table. The result
    is a table of trees for the next batch of edits.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks_path, pattern)

        def row(doc_id, text, n_tokens, chars, tokens, pieces, edits):
            if not edits:
                return doc_id, text, n_tokens, chars, tokens, pieces, n_tokens, 0, 0
            tree = CountTree(count, text, (chars, tokens, pieces))
            for e in edits:
                tree.edit(e["pos"] or 0, e["n_delete"] or 0, e["insert"] or "")
            return doc_id, tree.text, tree.n_tokens, *tree.leaves(), n_tokens, len(edits), tree.reencoded

        yield from _rows(EDITED, batches, row)

    return trees.select("doc_id", "text", "n_tokens", "chars", "tokens", "pieces", "edits").mapInArrow(walk, EDITED)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """trees (or documents) with the edits of a table (doc_id, edit_no, pos, n_delete, insert) as the array that edit_trees() takes.

    Edits of a doc_id go to every row that has it, in the order of edit_no;
    a document's edits are gathered in one row, as its text is. Edits that
    repeat are made as often; edits without a doc_id, or of one that no tree
    has, change nothing; empty edits leave every tree without any (null), and
    empty trees give an empty table. A column edits of trees is replaced, other
    columns are kept, whatever their names.
    """
    one = F.struct("edit_no", F.col("pos").cast("int").alias("pos"), F.col("n_delete").cast("int").alias("n_delete"), "insert")
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("_e"))
    bare = F.transform("_e", lambda e: F.struct(e["pos"].alias("pos"), e["n_delete"].alias("n_delete"), e["insert"].alias("insert")))
    return attach(trees.drop("edits"), lists.select("doc_id", bare.alias("edits")), ["doc_id"], "text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's kept tree after three edits that follow from doc_id: a word inserted, ten characters cut, five replaced."""
    import public_tokenizers

    coder = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = Scratch(spark, "token_counts").write(build_trees(documents(spark, sf_dir), *coder), "trees")
    spot = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.greatest(F.length("text"), F.lit(1))).cast("int").alias("pos")
    edit = lambda salt, n, text: F.struct(spot(salt), F.lit(n).alias("n_delete"), F.lit(text).alias("insert"))
    edited = edit_trees(trees.withColumn("edits", F.array(edit(1, 0, " revised"), edit(2, 10, ""), edit(3, 5, "it's 42\n"))), *coder)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return edited.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"), total("pieces").alias("n_pieces"), "n_pieces_reencoded", total("chars").alias("edited_chars"))
