"""WARC archives: a writer and a salvage reader.

Writing stays in the JVM: each page becomes the text of one record, and
Spark's text writer joins records by the two blank lines that end a record in
the format; the commit protocol makes the files safe against lost executors.
Reading takes each archive as bytes and walks it record by record. A record
that fails a check (version line, headers, length, end mark, payload digest)
is quarantined, and the bytes up to where the walk goes on are logged as a gap
with its reason. Where the record's length was sound (only the digest differs)
that is its end, so what its payload quotes is not taken for records.
Otherwise the reader searches for the next version line; what it finds may lie
inside the damaged record, and says so: up to where that one claims to end,
or, where it does not say, to the end of the archive. Each gzip member of a compressed archive is
inflated twice, in pieces: to learn whether it is sound and how much it holds,
then to be walked likewise, so that no more is held than the record in hand,
however large the member. After a damaged member the search is for the next
one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, attach

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "2024-01-01T00:00:00Z"
#: Records of an archive by the largest payload in it, (bytes, records): about 64 MB, so that one fits in a reader's memory.
#: Larger payloads go one to an archive.
ARCHIVES = ((64 << 10, 1000), (1 << 20, 64), (16 << 20, 4), (1 << 62, 1))
#: Bytes of a gzip member that are inflated at once.
PIECE = 4 << 20

RECORDS = (
    "path string, offset bigint, length bigint, kind string, reason string, record_type string, page_id bigint, url string,"
    " payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
)


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of 20 bits, four letters each."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html with payload_bytes, payload_digest and refers_to (null: the page is a response).

    Of the pages with equal payloads of at least ``least_bytes`` bytes, the
    one with the largest page_id (null: smallest) is the response; rows that
    repeat that page_id are responses too. Null html is an empty payload.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    told = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("bigint").alias("payload_bytes"), sha1_base32(html).alias("payload_digest"))
    groups = told.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    marked = attach(told, groups.filter("_n > 1").drop("_n"), ["payload_digest"], "page_id")
    return marked.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))).drop("_last")


def record_text(pages: DataFrame, damage: Column | None = None) -> DataFrame:
    """Columns value, the record of each row of with_revisits() without its end mark, and payload_bytes.

    damage, for drills, spoils records: 1 states a wrong digest, 2 a length
    that is seven bytes too long, 3 has no version line; others spoil nothing.
    """
    damage = F.lit(0) if damage is None else F.coalesce(damage, F.lit(0))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    digest = F.when(damage == 1, F.translate("payload_digest", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "BCDEFGHIJKLMNOPQRSTUVWXYZ234567A")).otherwise(F.col("payload_digest"))
    header = F.concat(
        F.when(damage == 3, F.lit(f"WARC/?.?{CRLF}")).otherwise(F.lit(f"WARC/1.1{CRLF}")),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        optional("WARC-Record-ID", urn("page_id")),
        F.lit(f"WARC-Date: {WRITTEN}{CRLF}"),
        optional("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%0A")),
        optional("WARC-Refers-To", urn("refers_to")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}{CRLF}")).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", (F.octet_length(block) + F.when(damage == 2, 7).otherwise(0)).cast("string")),
        F.lit(CRLF),
    )
    return pages.select(F.concat(header, block).alias("value"), "payload_bytes")


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, damage: Column | None = None) -> None:
    """Write pages (page_id, url, html; other columns are left out, whatever their names) as archives into a new folder.

    Null html is an empty payload, a null url or page_id leaves its header
    out; repeated rows make a record each. Archives are bounded by bytes:
    pages are written by classes of size, the larger the fewer to a file.
    Empty pages make a folder without records.
    """
    records = record_text(with_revisits(pages.select("page_id", "url", "html"), least_bytes), damage)
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    below = -1
    for most, n in ARCHIVES:
        some = records.filter((F.col("payload_bytes") > below) & (F.col("payload_bytes") <= most)) if largest > ARCHIVES[0][0] else records
        some.select("value").write.mode("append").option("lineSep", CRLF * 2).option("maxRecordsPerFile", n).text(path)
        below = most
        if largest <= most:
            break


_VERSION = re.compile(rb"(?<![^\n])WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
_ALGORITHMS = {"md5", "sha1", "sha224", "sha256", "sha384", "sha512"}


def _verified(stated: str, payload: bytes) -> bool | None:
    """Whether a payload has its stated digest (hex, base32 or base64); None where the algorithm is not known.

    A digest without an algorithm is read as SHA-1 where only that has its length.
    """
    name, colon, value = stated.rpartition(":")
    value = value.strip().rstrip("=")
    name = name.strip().lower().replace("-", "")
    if not colon:
        name = "sha1" if len(value) == 40 or len(value) == 32 and not re.fullmatch("[0-9A-Fa-f]+", value) else ""
    if name not in _ALGORITHMS:
        return None
    raw = hashlib.new(name, payload).digest()
    return value.lower() == raw.hex() or value.upper() == base64.b32encode(raw).decode().rstrip("=") or value in [f(raw).decode().rstrip("=") for f in (base64.b64encode, base64.urlsafe_b64encode)]


def _record(data: bytes, at: int) -> tuple[int, dict] | tuple[int, str]:
    """The offset after the record at an offset, and the record; or the offset that it claims to end at (-1: not known), and what is wrong with it."""
    if not _VERSION.match(data, at):
        return -1, "no version line"
    top = data.find(b"\r\n\r\n", at)
    if top < 0:
        return -1, "headers do not end"
    head = {}
    for row in re.sub(rb"\r\n[ \t]+", b" ", data[at:top]).split(b"\r\n")[1:]:
        name, colon, value = row.partition(b":")
        if not colon:
            return -1, "bad header"
        head[name.strip().lower()] = value.strip()
    if not head.get(b"content-length", b"").isdigit():
        return -1, "no length"
    begin, end = top + 4, top + 4 + int(head[b"content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return end, "no end mark"
    kind = head.get(b"warc-type", b"").decode("ascii", "replace")
    split = data.find(b"\r\n\r\n", begin, end)
    payload = data[split + 4 : end] if split >= 0 else data[begin:end]
    digest = head.get(b"warc-payload-digest", b"").decode("ascii", "replace")
    verified = _verified(digest, payload) if kind == "response" and digest else True
    if verified is False:
        return end + 4, "digest differs"
    number = lambda k: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", head.get(k, b""))) else None
    size = head.get(b"x-payload-length", b"")
    return end + 4, {
        "kind": "record",
        "reason": None if verified else "digest not verified",
        "record_type": kind,
        "page_id": number(b"warc-record-id"),
        "url": u.decode("utf-8", "replace") if (u := head.get(b"warc-target-uri")) is not None else None,
        "payload_digest": re.sub("^sha-?1:", "", digest, flags=re.I) or None,
        "payload_bytes": int(size) if size.isdigit() else len(payload),
        "refers_to": number(b"warc-refers-to"),
        "payload": None if kind == "revisit" else payload,
    }


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, plain or of gzip members, in order; together they cover every byte."""
    if data[:3] == _GZIP or (_GZIP in data and not _VERSION.search(data)):
        yield from _salvage_gzip(data)
    else:
        yield from _salvage_plain(data)


def _salvage_plain(data: bytes) -> Iterator[dict]:
    return _walked(iter([data]), len(data))


def _walked(pieces: Iterator[bytes], size: int) -> Iterator[dict]:
    """Records and gaps of ``size`` bytes that come in pieces; held are the bytes of the record, or of the gap's end, that is in hand."""
    held, base, at, doubtful = b"", 0, 0, 0
    gap: tuple[int, str] | None = None

    def hold(n: int) -> bool:
        """Whether n bytes from ``at`` on are there, after more pieces have been taken if need be."""
        nonlocal held, base, at
        if len(held) - at < n and base + len(held) < size:
            parts = [held[at:]]
            have = len(parts[0])
            while have < n and (piece := next(pieces, None)) is not None:
                parts.append(piece)
                have += len(piece)
            held, base, at = b"".join(parts), base + at, 0
        return len(held) - at >= n

    while gap or base + at < size:
        if gap:
            # held[at] has been looked at; a version line starts behind it.
            found = _VERSION.search(held, at + 1)
            if not found and base + len(held) < size:
                at = max(at, len(held) - 12)
                hold(len(held) - at + 1)
                continue
            at = found.start() if found else size - base
            yield {"offset": gap[0], "length": base + at - gap[0], "kind": "gap", "reason": gap[1]}
            gap = None
            continue
        hold(12)
        end, got = _record(held, at)
        if got == "headers do not end" and base + len(held) < size:
            hold(2 * (len(held) - at) + 1)
            continue
        if got == "no end mark" and len(held) < end + 4 <= size - base:
            hold(end + 4 - at)
            continue
        start, end = base + at, base + end if end >= 0 else -1
        if isinstance(got, dict):
            if start < doubtful:
                got["reason"] = got["reason"] or "may lie inside a damaged record"
            yield {"offset": start, "length": end - start, **got}
            at = end - base
        elif got == "digest differs":
            yield {"offset": start, "length": end - start, "kind": "gap", "reason": got}
            doubtful, at = end, end - base
        else:
            doubtful = end if start < end <= size else size
            gap = start, got


def _pieces(data: bytes, at: int) -> Iterator[bytes]:
    """What a member holds, up to its damage if it has any; returns the offset after it (-1: not known) and what is wrong with it."""
    unzip, step = zlib.decompressobj(31), 1 << 12
    while at < len(data):
        before, part = unzip.copy() if step > 1 else None, memoryview(data)[at : at + step]
        try:
            out = unzip.decompress(part, PIECE)
        except zlib.error:
            if step == 1:
                return -1, "bad member"
            unzip, step = before, step >> 4 or 1
            continue
        at += len(part) - len(unzip.unconsumed_tail) - len(unzip.unused_data)
        yield out
        if unzip.eof:
            return at, None
        step = min(2 * step, 1 << 18) if step >= 1 << 12 else step
    yield unzip.flush()
    return (at, None) if unzip.eof else (-1, "member cut short")


def _measured(data: bytes, at: int) -> tuple[int, int, str | None]:
    """How many bytes the member at an offset holds, the offset after it (-1: not known) and what is wrong with it."""
    if data[at : at + 3] != _GZIP:
        return 0, -1, "bad member"
    size, pieces = 0, _pieces(data, at)
    while True:
        try:
            size += len(next(pieces))
        except StopIteration as told:
            return size, *told.value


def _salvage_gzip(data: bytes) -> Iterator[dict]:
    """The records and gaps inside each member have the member's offset, the first its length and the others 0.

    A member that is cut short is right as far as it goes. What any other damaged member held before
    the damage showed may be false, so of its records only responses whose digest is right come out.
    The damage is the reason of these rows; a gap has the member's length.
    """
    at = 0
    while at < len(data):
        size, end, reason = _measured(data, at)
        if end > 0:
            rows = _walked(_pieces(data, at), size) if size else [{"kind": "gap", "reason": "empty member"}]
            for i, row in enumerate(rows):
                yield {**row, "offset": at, "length": 0 if i else end - at}
            at = end
            continue
        for row in _walked(_pieces(data, at), size):
            if row["kind"] == "record" and (reason == "member cut short" or row["record_type"] == "response" and row["payload_digest"] and not row["reason"]):
                yield {**row, "offset": at, "length": 0, "reason": row["reason"] or reason}
        to = data.find(_GZIP, at + 1)
        to = len(data) if to < 0 else to
        yield {"offset": at, "length": to - at, "kind": "gap", "reason": reason}
        at = to


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of RECORDS: the records of all archives in a folder, and the gaps that were quarantined.

    A record with a reason is kept, but its digest could not be verified, its
    gzip member is damaged, or it may be text that a damaged record quotes.
    payload_digest is as stated, without "sha1:". A folder without records or
    with empty files gives an empty table; records that repeat come out as
    often. An archive is held in memory as a whole while it is walked, and
    binaryFile reads files of up to 2 GB: those of write_warc() stay near 64 MB
    unless one payload is larger.
    """
    fields = [c.split()[0] for c in RECORDS.split(",")]
    schema = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for n, c in zip(fields, RECORDS.split(","), strict=True)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows, held = [], 0
                for r in salvage(content.as_py() or b""):
                    rows.append({"path": name.as_py(), **r} | ({} if payloads else {"payload": None}))
                    held += max(r["length"], len(r.get("payload") or b""))
                    if held > 8 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(walk, RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives."""
    path = f"{Scratch(spark, 'warc').root}/archives"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    read = read_warc(spark, path, payloads=False).filter("kind = 'record'")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drill of the salvage reader: every seventh page's record is damaged in one of three ways as it is written; per page that comes back, what op9 tells of it.

    A page that refers to a damaged one comes back, for its own record is sound; of damaged revisits only the digest is not checked.
    """
    path = f"{Scratch(spark, 'warc').root}/damaged"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_warc(pages, path, damage=F.when(F.pmod("page_id", F.lit(7)) == 0, F.pmod(F.floor(F.col("page_id") / 7), F.lit(3)) + 1))
    read = read_warc(spark, path, payloads=False).filter("kind = 'record'")
    return read.select("page_id", "payload_bytes", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS last,
         translate(array_to_string(list_transform(range(0, 8), lambda i: lpad(to_base(('0x' || sha1(h)[1 + 5 * i : 5 + 5 * i])::INT, 32), 4, '0')), ''),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""

WARC_SALVAGE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p WHERE page_id % 7 <> 0 OR (page_id // 7 % 3 = 0 AND page_id <> last)
"""
