"""BPE encoding and decoding, equal to the tokenizers library on every whole text.

A text of more than LEAF characters is cut into halves, and those again, down
to leaves that are encoded apart. The leaves are then joined pairwise up the
same tree: text around each join is encoded again in a growing window until
the window holds, on either side of the join, a token that the side has too at
the same place. All neighbours in the joined sequence are then neighbours in
an encoding of their text, which for BPE means that the whole is the encoding
of the whole. Trees of up to SPREAD characters are built inside one task; the
leaves of longer texts are rows of their own, which tasks encode in parallel.

A leaf (and a text that is one leaf) is encoded by its words where the
tokenizer is known to drop white space before it merges: each distinct word
once, remembered by the worker process. Elsewhere the library encodes it whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import SPACES, Scratch, attach, documents

#: Longest leaf in characters; the leaves of texts of more than SPREAD characters are dealt out to tasks.
LEAF, SPREAD = 8192, 32768
#: Words that one generation of a worker's memory holds; two are kept.
CACHE = 250_000
#: Characters of the first window around a join, and of the edges of a leaf whose tokens' places are kept.
FIRST_WINDOW, EDGE = 64, 512

OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

# Normalizers and a pre-tokenizer pattern under which words between ASCII white space are encoded apart.
# None of the normalizers joins characters across white space, and the pattern matches none.
APART_NORMALIZERS = ("NFC", "Replace", "Lowercase")
APART_REPLACE = r"\s+"
APART_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(4)
def words_stand_apart(path: str) -> bool:
    """Whether normalizer, pre-tokenizer and added tokens are those known to treat each word by itself."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    norm, pre = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
    norms = norm.get("normalizers", [norm] if norm else [])
    steps = pre.get("pretokenizers", [])
    return (
        all(n["type"] in APART_NORMALIZERS for n in norms)
        and all(n["pattern"] == {"Regex": APART_REPLACE} and n["content"] == " " for n in norms if n["type"] == "Replace")
        and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": APART_PATTERN}
        and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
        and not steps[1]["add_prefix_space"]
        and d["model"]["type"] == "BPE"
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in d.get("added_tokens", []))
    )


@lru_cache(4)
def coder_of(path: str) -> Coder:
    """One coder for each worker process, so what a task learns serves the next one."""
    return Coder(path)


class Coder:
    """Encodes and decodes whole texts of any length."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.apart = words_stand_apart(path)
        # A special token or a contraction at a window's edge may hang on what the window cuts off.
        self.margin = max([4, *(len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, texts: list[list[bytes]]) -> None:
        """Have every word of the texts in the young generation; new words are encoded many at a time, between spaces."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        new = []
        for w in {w for words in texts for w in words if w not in self.young}:
            if w in self.old:
                self.young[w] = self.old[w]
            else:
                new.append(w)
        for begin in range(0, len(new), 256):
            some = [w.decode("utf-8", "replace") for w in new[begin : begin + 256]]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in some)])
            at = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            ids, cuts = np.asarray(e.ids, "<u4").tobytes(), np.searchsorted(at, starts) * 4
            for i in range(len(some)):
                self.young[new[begin + i]] = ids[cuts[i] : cuts[i + 1]]

    def leaves(self, texts: list[bytes]) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of texts that are a leaf each."""
        if self.apart:
            words = [t.split() for t in texts]
            self._learn(words)
            return [b"".join(map(self.young.__getitem__, w)) for w in words]
        coded = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in coded]

    def encode(self, texts: list[bytes], leaf: int) -> list[bytes]:
        """Ids of whole texts; those of more than ``leaf`` characters come from the joined leaves of their trees."""
        whole = [t.decode("utf-8", "replace") if len(t) > leaf else "" for t in texts]
        cuts = [halves(len(w), leaf) for w in whole]
        parts = [[w[a:b].encode() for a, b in zip(c, c[1:], strict=False)] if len(c) > 2 else [t] for t, w, c in zip(texts, whole, cuts, strict=True)]
        coded = iter(self.leaves([p for ps in parts for p in ps]))
        out = []
        for w, c, ps in zip(whole, cuts, parts, strict=True):
            ids = [next(coded) for _ in ps]
            if len(ps) > 1:
                spans = [Span.leaf(self, w[a:b], a, i) for a, b, i in zip(c, c[1:], ids, strict=False)]
                ids = [join_tree(self, w, spans).ids.tobytes()]
            out.append(ids[0])
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        return [t.encode() for t in self.tokenizer.decode_batch([np.frombuffer(i, "<u4").tolist() for i in ids], skip_special_tokens=False)]


def halves(n: int, leaf: int) -> list[int]:
    """Where a text of n characters is cut: at halves, quarters, ... until no part is longer than a leaf."""
    parts = 1
    while parts * leaf < n:
        parts *= 2
    return [n * i // parts for i in range(parts + 1)]


class Span:
    """The encoding of text[begin:end]: all ids, and the places (start, end) of the first and last tokens.

    head holds the places of the first len(head) tokens, tail of the last
    len(tail); a span whose head has all its tokens is known throughout.
    """

    def __init__(self, begin: int, end: int, ids: np.ndarray, head: np.ndarray, tail: np.ndarray):
        self.begin, self.end, self.ids, self.head, self.tail = begin, end, ids, head, tail

    @classmethod
    def encode(cls, coder: Coder, text: str, begin: int) -> Span:
        """By the library as a whole."""
        e = coder.tokenizer.encode(text, add_special_tokens=False)
        at = np.asarray(e.offsets, np.int64).reshape(-1, 2) + begin
        return cls(begin, begin + len(text), np.asarray(e.ids, "<u4"), at, at)

    @classmethod
    def leaf(cls, coder: Coder, text: str, begin: int, ids: bytes) -> Span:
        """From a leaf's ids: only its two edges, up to white space, are encoded again for the places of their tokens."""
        a = min((i for c in SPACES if (i := text.find(c, EDGE)) >= 0), default=-1)
        b = max(text.rfind(c, 0, max(len(text) - EDGE, 0)) for c in SPACES)
        if not coder.apart or a < 0 or b < 0:
            return cls.encode(coder, text, begin)
        head, tail = cls.encode(coder, text[:a], begin), cls.encode(coder, text[b:], begin + b)
        return cls(begin, begin + len(text), np.frombuffer(ids, "<u4"), head.head, tail.tail)

    def tails(self) -> dict[tuple[int, int, int], int]:
        """Known last tokens after which no other token reaches into the same character: (start, end, id) -> index."""
        base = len(self.ids) - len(self.tail)
        nxt = np.append(self.tail[1:, 0], np.iinfo(np.int64).max)[: len(self.tail)]
        return {(int(self.tail[i, 0]), int(self.tail[i, 1]), int(self.ids[base + i])): base + int(i) for i in np.flatnonzero(nxt >= self.tail[:, 1])}

    def heads(self) -> dict[tuple[int, int, int], int]:
        prev = np.insert(self.head[:-1, 1], 0, -1)[: len(self.head)]
        return {(int(self.head[i, 0]), int(self.head[i, 1]), int(self.ids[i])): int(i) for i in np.flatnonzero(prev <= self.head[:, 0])}


def join_spans(coder: Coder, text: str, left: Span, right: Span) -> Span:
    """The encoding of both spans' text: a window around the join grows until both sides agree with it.

    A window that grows beyond the known places of a side takes that whole side.
    """
    cut, w, margin = left.end, FIRST_WINDOW, coder.margin
    ends, starts = left.tails(), right.heads()
    while True:
        a, b = max(left.begin, cut - w), min(right.end, cut + w)
        if len(left.tail) < len(left.ids) and (not len(left.tail) or a < left.tail[0, 0]):
            a = left.begin
        if len(right.head) < len(right.ids) and (not len(right.head) or b > right.head[-1, 1]):
            b = right.end
        mid = Span.encode(coder, text[a:b], a)
        lo = hi = None
        if a == left.begin:
            lo = (0, 0)
        else:
            both = [(i, ends[k]) for k, i in mid.tails().items() if k in ends and a + margin <= k[0] and k[1] < cut]
            if both:
                i, j = max(both)
                lo = (j + 1, i + 1)
        if b == right.end:
            hi = (len(mid.ids), len(right.ids))
        else:
            both = [(i, starts[k]) for k, i in mid.heads().items() if k in starts and k[0] > cut and k[1] + margin <= b]
            if both:
                hi = min(both)
        if lo and hi and lo[1] <= hi[0]:
            return _joined(left, mid, right, lo, hi)
        w *= 2


def _joined(left: Span, mid: Span, right: Span, lo: tuple[int, int], hi: tuple[int, int]) -> Span:
    """left's first lo[0] tokens, mid's from lo[1] to hi[0], right's from hi[1]; places as far as they are known from the edges."""
    middle = mid.head[lo[1] : hi[0]]
    ids = np.concatenate([left.ids[: lo[0]], mid.ids[lo[1] : hi[0]], right.ids[hi[1] :]])
    head = left.head[: lo[0]]
    if len(head) == lo[0]:
        head = np.concatenate([head, middle, right.head[hi[1] :]])
    tail = right.tail[max(0, hi[1] - (len(right.ids) - len(right.tail))) :]
    if len(tail) == len(right.ids) - hi[1]:
        base = len(left.ids) - len(left.tail)
        tail = np.concatenate([left.tail[: max(0, lo[0] - base)], middle, tail])
    return Span(left.begin, right.end, ids, head, tail)


def join_tree(coder: Coder, text: str, leaves: list[Span]) -> Span:
    """Neighbours joined pairwise, level by level."""
    while len(leaves) > 1:
        leaves = [join_spans(coder, text, *leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def _digests(coder: Coder, ids: list[bytes]) -> dict[str, pa.Array]:
    return {
        "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in coder.decode(ids)], pa.string()),
    }


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def _by_rows(long: DataFrame, path: str, leaf: int, shape: str, finish) -> DataFrame:
    """Texts (sha, text) of more than one leaf, each once, with the leaves of all of them dealt out over the tasks.

    finish(coder, ids) gives the columns of ``shape`` besides sha.
    """
    n = F.expr(f"shiftleft(1, cast(greatest(ceil(log2(length(text) / {float(leaf)!r}D)), 0) as int))")
    cut = long.select("sha", "text", n.alias("n")).select("sha", "text", "n", F.explode(F.expr("sequence(0, n - 1)")).alias("leaf"))
    edge = lambda i: f"cast(floor(cast(length(text) as bigint) * ({i}) / n) as int)"
    pieces = cut.select("sha", "leaf", F.expr(f"substring(text, {edge('leaf')} + 1, {edge('leaf + 1')} - {edge('leaf')})").alias("text"))
    once = pieces.groupBy("sha", "leaf").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for part in _slices(batches, 16):
            texts = part["text"].to_pylist()
            spans = [Span.leaf(coder, t, 0, i) for t, i in zip(texts, coder.leaves([t.encode() for t in texts]), strict=True)]
            cols = {k: pa.array([np.ascontiguousarray(getattr(s, k), "<u4").tobytes() for s in spans], pa.binary()) for k in ("ids", "head", "tail")}
            yield pa.record_batch({k: part[k] for k in ("sha", "leaf", "text")} | cols)

    encoded = once.mapInArrow(encode, "sha string, leaf int, text string, ids binary, head binary, tail binary")

    def join(group: pa.Table) -> pa.Table:
        coder, text, spans = coder_of(path), "", []
        for r in sorted(group.to_pylist(), key=lambda r: r["leaf"]):
            at = lambda k, r=r, begin=len(text): np.frombuffer(r[k], "<u4").astype(np.int64).reshape(-1, 2) + begin
            spans.append(Span(len(text), len(text) + len(r["text"]), np.frombuffer(r["ids"], "<u4"), at("head"), at("tail")))
            text += r["text"]
        return pa.table({"sha": group["sha"][:1]} | finish(coder, [join_tree(coder, text, spans).ids.tobytes()]))

    return encoded.groupBy("sha").applyInArrow(join, f"sha string, {shape}")


def _encoded(docs: DataFrame, path: str, leaf: int, spread: int, shape: str, finish) -> DataFrame:
    """doc_id and the columns of ``shape`` that finish(coder, ids) makes, a row for each row of docs."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    wide = F.length("text") > max(spread, leaf)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for part in _slices(batches):
            yield pa.record_batch({"doc_id": part["doc_id"]} | finish(coder, coder.encode(part["text"].to_pylist(), leaf)))

    here = slim.filter(~wide).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(encode, f"doc_id bigint, {shape}")
    keyed = slim.filter(wide).withColumn("sha", F.sha2("text", 256))
    joined = Scratch(docs.sparkSession, "bpe").write(_by_rows(keyed.select("sha", "text"), path, leaf, shape, finish), "joined")
    rows = keyed.select("doc_id", "sha", F.monotonically_increasing_id().alias("row"))
    return here.unionByName(attach(rows, joined, ["sha"], "row", "inner").drop("sha", "row"))


def encode_digests(docs: DataFrame, tokenizer_path: str, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty (no tokens); a text of any length is encoded
    whole. Columns other than doc_id and text are left out, whatever their
    names; repeated rows give repeated rows, null doc_ids stay null; empty
    input gives an empty result.
    """
    return _encoded(docs, tokenizer_path, leaf, spread, OUT.partition(", ")[2], _digests)


def encode_ids(docs: DataFrame, tokenizer_path: str, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """doc_id and the token ids themselves (array<int>), for writing training shards; rows as in encode_digests()."""

    def finish(coder: Coder, ids: list[bytes]) -> dict[str, pa.Array]:
        return {"ids": pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32()))}

    return _encoded(docs, tokenizer_path, leaf, spread, "ids array<int>", finish)


def decode_ids(coded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids array<int>), special tokens kept.

    Null and empty ids give the empty text; ids of any length are decoded
    whole; repeated rows give repeated rows; a null doc_id is handed on; other
    columns are left out, whatever their names; empty rows give an empty table.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = coder_of(tokenizer_path).tokenizer
        for part in _slices(batches):
            told = t.decode_batch([i or [] for i in part["ids"].to_pylist()], skip_special_tokens=False)
            yield pa.record_batch({"doc_id": part["doc_id"], "text": pa.array(told, pa.string())})

    return coded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), tokenizer_path())
