"""Very many phrases found or replaced in texts in one pass, by an Aho-Corasick automaton.

An automaton walks a text once, whatever the number of phrases. find_phrases()
builds one of the whole dictionary in each worker process. join_phrases() and
replace_phrases() take dictionaries of any size: texts go in blocks, and a
block's automaton holds the phrases that the block may have, which a join of
hashes finds. Of the phrases that overlap, the leftmost is taken, of those that begin together the
longest. Letters count alike in either case; a phrase must not touch another
letter, digit or low line.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lorespark.scratch import Scratch

#: Characters of all phrases of a dictionary together: what an automaton of a few hundred MB holds.
MOST = 8_000_000
#: A block of texts is 2^BLOCK_BITS of them at most.
BLOCK_BITS = 9

_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_BUILT: dict[str, ahocorasick.Automaton] = {}


def folded(text: str) -> str:
    """The text in lower case, letter by letter, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def automaton(phrases: list[tuple], version: str) -> ahocorasick.Automaton:
    """The automaton of (phrase, ...) rows; the one of the version that was used last is kept."""
    if version not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for row in phrases:
            built.add_word(folded(row[0]), (len(row[0]), row))
        built.make_automaton()
        _BUILT[version] = built
    return _BUILT[version]


def spans(text: str, built: ahocorasick.Automaton) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, row) of the phrases of a text, leftmost and longest first, none over another."""
    free, n = 0, len(text)
    found: list[tuple[int, int, tuple]] = []
    for last, (size, row) in built.iter(folded(text)):
        start, end = last - size + 1, last + 1
        if not (start and text[start - 1] in _WORD or end < n and text[end] in _WORD):
            found.append((start, -end, row))
    # Hits come by their ends.
    found.sort(key=lambda x: x[:2])
    for start, end, row in found:
        if start >= free:
            free = -end
            yield start, free, row


def _distinct(dictionary: DataFrame, columns: list[str]) -> DataFrame:
    """The dictionary's rows, phrases distinct but for case; empty phrases are left out."""
    return dictionary.filter(F.length("phrase") > 0).groupBy(F.lower("phrase").alias("_low")).agg(F.min(F.struct("phrase", *columns)).alias("r")).select("r.*")


def held(dictionary: DataFrame, columns: list[str]) -> list[tuple]:
    """The dictionary's rows as in _distinct(), after its size has been measured."""
    rows = _distinct(dictionary, columns)
    size = rows.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()[0]
    if size > MOST:
        raise ValueError(f"the phrases have {size} characters; an automaton takes {MOST}: give the dictionary in parts")
    return [tuple(r) for r in rows.collect()]


def _mapped(df: DataFrame, dictionary: DataFrame, columns: list[str], each: Callable, text: str, shape: str, kinds: list[tuple[str, pa.DataType]]) -> DataFrame:
    """df with columns that ``each`` tells of a text and the automaton."""
    shared, version = df.sparkSession.sparkContext.broadcast(held(dictionary, columns)), uuid.uuid4().hex

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automaton(shared.value, version)
        for batch in batches:
            told = [each(t, built) for t in batch[text].to_pylist()]
            cols = [pa.array([x[k] for x in told], kind) for k, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *[n for n, _ in kinds]])

    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [shape])
    return df.mapInArrow(walk, schema)


def _hashed(phrases: DataFrame) -> DataFrame:
    """phrases with _h, the CRC-32 of the folded phrase, and _n, its characters."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [folded(p) for p in batch["phrase"].to_pylist()]
            cols = [pa.array([zlib.crc32(x.encode()) for x in low], pa.int64()), pa.array([len(x) for x in low], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "_h", "_n"])

    return phrases.mapInArrow(walk, StructType([*phrases.schema.fields, StructField("_h", LongType()), StructField("_n", LongType())]))


def _bitmap(hashed: DataFrame) -> bytes:
    """The upper 26 bits of all hashes as a bitmap of 8 MB, whatever their number."""
    words = np.zeros(1 << 20, "<i8")
    bit = F.expr("shiftleft(1L, cast(shiftright(_h, 6) & 63 as int))")
    told = hashed.groupBy(F.shiftright("_h", 12).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words[told["at"].to_numpy()] = told["bits"].to_numpy()
    return words.tobytes()


def windows(text: str, lengths: list[int], bitmap: bytes) -> set[int]:
    """Hashes, as far as the bitmap has them, of a text's parts of the given lengths (ascending) that touch no other letter, digit or low line."""
    low, n, out = folded(text), len(text), set()
    if low.isascii():
        part = low.encode()
        hash_of = lambda a, b: zlib.crc32(part[a:b])
    else:
        hash_of = lambda a, b: zlib.crc32(low[a:b].encode(errors="replace"))
    free = [c not in _WORD for c in text] + [True]
    stops, some, longest, k = [i for i in range(1, n + 1) if free[i]], set(lengths), max(lengths, default=0), 0
    for start in range(n):
        if not start or free[start - 1]:
            while stops[k] <= start:
                k += 1
            for end in stops[k : k + longest]:
                if end - start > longest:
                    break
                if end - start in some:
                    h = hash_of(start, end)
                    if bitmap[h >> 9] >> ((h >> 6) & 7) & 1:
                        out.add(h)
    return out


def _joined(df: DataFrame, dictionary: DataFrame, columns: list[str], each: Callable, text: str, shape: str, kinds: list[tuple[str, pa.DataType]]) -> DataFrame:
    """As _mapped(), for dictionaries of any size: no worker holds more than a bitmap of 8 MB, a block of texts and the phrases that it may have."""
    scratch = Scratch(df.sparkSession, "phrases")
    hashed = scratch.write(_hashed(_distinct(dictionary, columns)), "dictionary")
    lengths = sorted(hashed.agg(F.collect_set("_n")).first()[0])
    bitmap = df.sparkSession.sparkContext.broadcast(_bitmap(hashed))
    # Block numbers are given once, as the table is written.
    texts = scratch.write(df.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "texts")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, set[int]] = {}
            for block, t in zip(batch["_block"].to_pylist(), batch["_t"].to_pylist(), strict=True):
                found.setdefault(block, set()).update(windows(t, lengths, bitmap.value))
            yield pa.record_batch({"_block": pa.array([b for b, hs in found.items() for _ in hs], pa.int64()), "_h": pa.array([h for hs in found.values() for h in hs], pa.int64())})

    likely = texts.select("_block", F.col(text).alias("_t")).filter("_t <> ''").mapInArrow(walk, "_block bigint, _h bigint").distinct()
    # Phrases of equal hash come along; the automaton tells them apart.
    wanted = scratch.write(likely.join(hashed, "_h").select("_block", "phrase", *columns), "wanted")

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        built = ahocorasick.Automaton()
        for row in sorted(zip(*[right[c].to_pylist() for c in ["phrase", *columns]], strict=True), key=lambda r: r[0], reverse=True):
            built.add_word(folded(row[0]), (len(row[0]), row))
        built.make_automaton()
        told = [each(t, built) for t in left[text].to_pylist()]
        out = left.drop_columns("_block")
        for k, (name, kind) in enumerate(kinds):
            out = out.append_column(name, pa.array([x[k] for x in told], kind))
        return out

    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [shape])
    return texts.groupBy("_block").cogroup(wanted.groupBy("_block")).applyInArrow(tell, schema)


def _hits(way: Callable, df: DataFrame, dictionary: DataFrame, text: str, values: list[str]) -> DataFrame:
    fields = [("start", pa.int32()), ("length", pa.int32()), ("phrase", pa.string()), *[(v, pa.string()) for v in values]]

    def each(t: str | None, built: ahocorasick.Automaton) -> tuple:
        return ([dict(zip([n for n, _ in fields], (a, b - a, *row), strict=True)) for a, b, row in spans(t or "", built)],) if len(built) else ([],)

    shape = "hits array<struct<start: int, length: int, phrase: string" + "".join(f", `{v}`: string" for v in values) + ">>"
    return way(df, dictionary, values, each, text, shape, [("hits", pa.list_(pa.struct(fields)))])


def find_phrases(df: DataFrame, dictionary: DataFrame, text: str = "text", values: list[str] = ()) -> DataFrame:
    """df with hits, an array of (start, length, phrase, values...) of the phrases of its text, in order; start counts characters from 0.

    dictionary: phrase and the columns ``values`` (strings); of phrases equal
    but for case the first by phrase, then values, counts. A null text has no
    hits. Texts go whole; the dictionary may hold MOST characters.
    """
    return _hits(_mapped, df, dictionary, text, list(values))


def join_phrases(df: DataFrame, dictionary: DataFrame, text: str = "text", values: list[str] = ()) -> DataFrame:
    """As find_phrases(), with a dictionary of any size."""
    return _hits(_joined, df, dictionary, text, list(values))


def _cased(official: str, found: str) -> str:
    """The official name with a capital if what was found has one, else in lower case."""
    return official[:1].upper() + official[1:] if found[:1].upper() == found[:1] else official.lower()


def replace_phrases(df: DataFrame, dictionary: DataFrame, text: str = "text", tag: bool = False, out: str = "replaced") -> DataFrame:
    """df with its text in which each phrase has given way to its official name; with tag, to [KIND:Official].

    dictionary: phrase, official and, for tags, kind. A phrase found with a
    capital gets the official name with a capital, another one the name in
    lower case; tags hold it as it is. Official names are phrases of their own
    when tags are made, and what already stands in brackets is left alone. A
    null text stays null. Dictionaries may have any size. Other cases as in
    find_phrases().
    """
    columns = ["official", "kind"] if tag else ["official"]
    if tag:
        own = dictionary.select(F.col("official").alias("phrase"), "official", "kind")
        known = dictionary.select(F.lower("phrase").alias("_low")).distinct()
        dictionary = dictionary.select("phrase", *columns).union(own.withColumn("_low", F.lower("phrase")).join(known, "_low", "left_anti").drop("_low"))

    def each(t: str | None, built: ahocorasick.Automaton) -> tuple:
        if not t or not len(built):
            return (t,)
        parts, at, inside = [], 0, _bracketed(t) if tag else None
        for a, b, row in spans(t, built):
            if tag and inside[a]:
                continue
            parts += [t[at:a], f"[{row[2].upper()}:{row[1]}]" if tag else _cased(row[1], t[a:b])]
            at = b
        return ("".join(parts) + t[at:],)

    return _joined(df.drop(out), dictionary, columns, each, text, f"`{out}` string", [(out, pa.string())])


def _bracketed(text: str) -> list[bool]:
    """For each character whether a closing bracket follows it before any opening one."""
    out, inside = [False] * len(text), False
    for i in range(len(text) - 1, -1, -1):
        out[i] = inside
        if text[i] in "[]":
            inside = text[i] == "]"
    return out
