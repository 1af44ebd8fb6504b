"""Token counts, BPE and WARC: exact round trips and library results."""

import base64
import gzip
import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest

from lorespark.llm import bpe, warc
from lorespark.llm.token_counts import CountTree, build_trees, counter, edit_trees, op2_token_counts, with_edits
from lorespark.llm.warc import read_warc, salvage, write_warc

WORD, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string"


def texts(seed, n, alphabet, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def want(text):
    t = bpe._tokenizer(WORD)
    ids = t.encode(text or "", add_special_tokens=False).ids
    told = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(told.encode()).hexdigest()


def test_bpe_equals_library(spark):
    some = [None, "", "  ", "Hello, World's don't", "<|endoftext|> x<|startoftext|>y", "x\x00y\x1cz", "é ́", "日本語 " * 50]
    some += texts(1, 40, "abcdefg'stéÉ̈İ12!?  \n\tzqu日本👍", 400)
    some += texts(2, 6, "abcdefghinorst'é!1", 3000) + [some[3], some[3]]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(some)], DOCS)
    for spread in (200, 1000, 10**6):
        got = {r["doc_id"]: tuple(r)[1:] for r in bpe.encode_digests(df, WORD, leaf=200, spread=spread).collect()}
        assert got == {i: want(t) for i, t in enumerate(some)}
    twice = spark.createDataFrame([(1, "q" * 900, "en")] * 3, DOCS)
    assert [tuple(r)[1:] for r in bpe.encode_digests(twice, WORD, leaf=200, spread=200).collect()] == [want("q" * 900)] * 3
    assert bpe.encode_digests(df.limit(0), WORD).count() == 0


def test_every_way_gives_the_same_ids_on_the_table(spark):
    """Whole texts of a table: one leaf each, trees inside a task, trees over tasks."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = sorted((r["doc_id"], *want(r["text"])) for r in docs.select("doc_id", "text").collect())
    for leaf, spread in ((10**6, 10**6), (300, 10**6), (300, 300)):
        assert sorted(map(tuple, bpe.encode_digests(docs, WORD, leaf, spread).collect())) == expected


def test_ids_and_texts_come_back(spark):
    """A byte-level tokenizer, whose words don't stand apart, loses nothing."""
    path = P.path("byte_bpe_50k.json")
    assert bpe.words_stand_apart(WORD) and not bpe.words_stand_apart(path)
    some = [None, "", " a  b\n\n c", "x" * 700, *texts(7, 20, "ab c'sté12!  \n日👍", 900)]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(some)], "doc_id bigint, text string, ids string")
    t = bpe._tokenizer(path)
    for spread in (100, 10**6):
        coded = bpe.encode_ids(df, path, leaf=100, spread=spread)
        assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {i: t.encode(x or "").ids for i, x in enumerate(some)}
    assert {r["doc_id"]: r["text"] for r in bpe.decode_ids(coded, path).collect()} == {i: x or "" for i, x in enumerate(some)}


def test_worker_memory_is_renewed(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    coder = bpe.Coder(WORD)
    for s in texts(8, 60, "abé'12! ", 200):
        assert coder.encode([s.encode()], 50)[0] == np.asarray(coder.tokenizer.encode(s).ids, "<u4").tobytes()
        assert len(coder.young) < 200


@pytest.mark.parametrize("alphabet", ["abcdefghinorst", "aé'st́İ!1 ", "aaab", "ab c"])
@pytest.mark.parametrize("edge", [0, 5, 512])
def test_join_windows_grow_until_sides_agree(monkeypatch, alphabet, edge):
    monkeypatch.setattr(bpe, "FIRST_WINDOW", 2)
    monkeypatch.setattr(bpe, "EDGE", edge)
    coder = bpe.Coder(WORD)
    for s in texts(3, 100, alphabet, 300):
        s = s + "<|endoftext|>" + s
        cuts = [len(s) * i // 8 for i in range(9)]
        ids = coder.leaves([s[a:b].encode() for a, b in zip(cuts, cuts[1:], strict=False)])
        spans = [bpe.Span.leaf(coder, s[a:b], a, i) for a, b, i in zip(cuts, cuts[1:], ids, strict=False)]
        assert bpe.join_tree(coder, s, spans).ids.tolist() == coder.tokenizer.encode(s, add_special_tokens=False).ids


def test_count_tree_follows_edits():
    count, rng = counter(RANKS, P.PATTERN), random.Random(4)
    alphabet = "ab cd's  \n\n 12!? é日\x1c\x85"
    for s in texts(5, 200, alphabet, 900):
        tree = CountTree(count, s)
        for _ in range(6):
            tree.edit(rng.randint(-2, len(tree.text) + 3), rng.choice([0, 3, 40, 300]), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 60]))))
            assert tree.n_tokens == len(count.coder.encode_ordinary(tree.text))


def test_edits_reencode_little():
    tree = CountTree(counter(RANKS, P.PATTERN), "some words in a row " * 5000)
    tree.edit(50_000, 4, "other")
    assert tree.reencoded < 200 and tree.n_tokens == len(tree.count.coder.encode_ordinary(tree.text))


def test_trees_are_kept_between_edits():
    """A tree put together from its leaves goes on as the one they came from."""
    count, rng = counter(RANKS, P.PATTERN), random.Random(9)
    for s in ["", *texts(10, 40, "ab cd's  \n 12!é日", 2500)]:
        one, two = CountTree(count, s), CountTree(count, s)
        for _ in range(5):
            edit = rng.randint(0, len(s) + 3), rng.choice([0, 3, 900, 5000]), rng.choice(["", "x y", "long " * 300])
            one.edit(*edit)
            two = CountTree(count, two.text, two.leaves())
            two.edit(*edit)
            assert (two.text, two.n_tokens, two.pieces[1]) == (one.text, one.n_tokens, one.pieces[1])
            assert two.n_tokens == len(count.coder.encode_ordinary(two.text))


def test_edited_trees_odd_rows(spark):
    df = spark.createDataFrame([(1, "hello world", "en"), (2, None, "en"), (None, "", "en"), (1, "hello world", "en"), (1 << 62, "a" * 50, "en")], "doc_id bigint, text string, edits string")
    edits = spark.createDataFrame([(1, 0, 5, 0, " big"), (1, 1, 0, 5, "bye"), (2, 0, 7, 9, None), (9, 0, 0, 0, "x")], "doc_id bigint, edit_no int, pos int, n_delete int, insert string")
    trees = build_trees(df, RANKS, P.PATTERN)
    once = edit_trees(with_edits(trees, edits), RANKS, P.PATTERN)
    n = len(counter(RANKS, P.PATTERN).coder.encode_ordinary("a" * 50))
    row = lambda r: (str(r["doc_id"]), r["n_tokens_before"], r["n_tokens"], r["n_edits"], len(r["text"]))
    assert sorted(map(row, once.collect())) == [("1", 2, 3, 2, 13), ("1", 2, 3, 2, 13), ("2", 0, 0, 1, 0), (str(1 << 62), n, n, 0, 50), ("None", 0, 0, 0, 0)]
    twice = edit_trees(with_edits(once, edits.filter("doc_id = 1 and edit_no = 1")), RANKS, P.PATTERN)
    assert sorted(r["text"] for r in twice.filter("doc_id = 1").collect()) == ["byeig world"] * 2
    assert edit_trees(with_edits(build_trees(df.limit(0), RANKS, P.PATTERN), edits), RANKS, P.PATTERN).count() == 0


def test_op2_with_large_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(1 << 62, "a b c d e f g " * 9, "en"), (-5, "x", "en"), (None, None, "en")], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_token_counts(spark, str(tmp_path)).collect()
    assert len(got) == 3 and all(r["n_edits"] == 3 for r in got)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n" * 30_000
    rows = [(1, "http://a/\nb", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x\r\n\r\ny\x00"), (6, "u", big), (None, "u", "only"), (7, "u", "x")]
    write_warc(pages(spark, rows), str(tmp_path / "w"))
    got = {r["page_id"]: r for r in read_warc(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows) and {r["kind"] for r in got.values()} == {"record"}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if got[i]["record_type"] == "response":
            assert bytes(got[i]["payload"]) == data
    assert (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"]) == ("revisit", 2, "response")
    assert got[3]["refers_to"] == 4 and got[1]["url"] == "http://a/%0Ab"


def archive(spark, tmp_path, n=12):
    write_warc(pages(spark, [(i, f"http://a/{i}", f"<p>{i}</p>" * 20) for i in range(n)]).coalesce(1), str(tmp_path / "w"))
    (path,) = (tmp_path / "w").glob("part-*")
    return path.read_bytes()


def test_salvage_of_damaged_archives(spark, tmp_path):
    data = archive(spark, tmp_path)
    spans = [(r["offset"], r["length"], r["page_id"]) for r in salvage(data)]
    assert len(spans) == 12 and sum(n for _, n, _ in spans) == len(data)
    rng = random.Random(6)
    for _ in range(60):
        broken, hit = bytearray(data), set()
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(data))
            broken[at] ^= 0x5A
            hit |= {i for o, n, i in spans if o <= at < o + n}
        got = list(salvage(bytes(broken)))
        assert sum(r["length"] for r in got) == len(data)
        found = {r["page_id"] for r in got if r["kind"] == "record"}
        assert {i for _, _, i in spans} - hit <= found
    cut = list(salvage(data[: spans[-1][0] + 50]))
    assert [r["kind"] for r in cut] == ["record"] * 11 + ["gap"]


def test_salvage_of_gzip_members(spark, tmp_path):
    data = archive(spark, tmp_path)
    members = [gzip.compress(data[r["offset"] : r["offset"] + r["length"]]) for r in salvage(data)]
    assert [r["page_id"] for r in salvage(b"".join(members))] == [r["page_id"] for r in salvage(data)]
    bad = bytearray(members[3])
    bad[len(bad) // 2] ^= 0xFF
    got = list(salvage(b"".join([*members[:3], bytes(bad), *members[4:]])))
    assert sum(r["kind"] == "record" for r in got) == 11 and any(r["kind"] == "gap" for r in got)
    assert sum(r["length"] for r in got) == sum(map(len, members))


def foreign(i, digest=None, fold=False):
    """A response of another writer."""
    html = f"<p>{i}</p>".encode() * 9
    block = b"HTTP/1.1 200 OK\r\n\r\n" + html
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI:{chr(13) + chr(10) if fold else ''} http://f/{i}\r\n"
    head += f"WARC-Payload-Digest: {digest(html)}\r\n" if digest else ""
    return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_salvage_of_foreign_digests_and_folded_headers():
    b32 = lambda n, x: base64.b32encode(hashlib.new(n, x).digest()).decode()
    right = [
        lambda x: "sha256:" + hashlib.sha256(x).hexdigest(),
        lambda x: "SHA-256:" + b32("sha256", x),
        lambda x: "md5:" + hashlib.md5(x).hexdigest().upper(),
        lambda x: "sha1:" + hashlib.sha1(x).hexdigest(),
        lambda x: "sha1:" + b32("sha1", x).lower(),
        lambda x: "sha512:" + base64.b64encode(hashlib.sha512(x).digest()).decode(),
        lambda x: b32("sha1", x),
    ]
    got = list(salvage(b"".join(foreign(i, d, fold=i % 2 == 0) for i, d in enumerate(right))))
    assert [(r["kind"], r["reason"], r["page_id"], r["url"]) for r in got] == [("record", None, i, f"http://f/{i}") for i in range(len(right))]
    wrong = list(salvage(b"".join(foreign(i, lambda x, d=d: d(x + b"?")) for i, d in enumerate(right))))
    assert [(r["kind"], r["reason"]) for r in wrong] == [("gap", "digest differs")] * len(right)
    (odd,) = salvage(foreign(1, lambda x: "blake9:abc"))
    assert (odd["kind"], odd["reason"], odd["payload_digest"]) == ("record", "digest not verified", "blake9:abc")


def test_salvage_of_foreign_gzip():
    sha1 = lambda x: "sha1:" + hashlib.sha1(x).hexdigest()
    plain = [foreign(i, sha1) for i in range(9)]
    ids = lambda data: [r["page_id"] for r in salvage(data) if r["kind"] == "record"]
    whole = gzip.compress(b"".join(plain))
    pairs = b"".join(gzip.compress(b"".join(plain[i : i + 2])) for i in range(0, 9, 2))
    assert ids(whole) == ids(pairs) == list(range(9))
    damaged = gzip.compress(b"".join([*plain[:4], plain[4].replace(b"<p>", b"<q>"), *plain[5:]]))
    assert ids(damaged) == [0, 1, 2, 3, 5, 6, 7, 8] and [r["reason"] for r in salvage(damaged) if r["kind"] == "gap"] == ["digest differs"]
    stored = gzip.compress(b"".join(plain), 0)
    cut, bad = stored[: len(stored) * 2 // 3], stored[:-8] + bytes(8)
    assert ids(cut) == list(range(5 + (ids(cut)[-1] == 5))) and ids(bad) == list(range(9))
    for data in (whole, pairs, damaged, cut, bad, whole + gzip.compress(b"") + pairs):
        assert sum(r["length"] for r in salvage(data)) == len(data)


def test_members_are_walked_in_pieces(monkeypatch):
    """Sound and damaged archives in one member give the same in pieces of a few bytes as in one piece, and little is held."""
    sha1 = lambda x: "sha1:" + hashlib.sha1(x).hexdigest()
    rng = random.Random(11)
    plain = b"".join(foreign(i, sha1 if i % 3 else None, fold=i % 4 == 0) for i in range(40))
    for k in range(30):
        data = bytearray(plain)
        for _ in range(k % 6):
            data[rng.randrange(len(data))] ^= 0x5A
        if k % 5 == 4:
            data[:] = b"\x00" * 5000 + bytes(data)[: -rng.randrange(1, 400)]
        for level in (0, 6):
            member = gzip.compress(bytes(data), level)
            whole = list(salvage(member))
            monkeypatch.setattr(warc, "PIECE", rng.choice([1, 7, 300, 5000]))
            assert list(salvage(member)) == whole
            assert list(salvage(member[: len(member) * 2 // 3])) == list(salvage(member[: len(member) * 2 // 3]))
            monkeypatch.undo()
        told = lambda rows: [(r["kind"], r["reason"], r.get("page_id")) for r in rows]
        assert told(whole) == told(salvage(bytes(data)))


def test_a_large_member_is_not_held(monkeypatch):
    import tracemalloc

    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 100_000
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    member = gzip.compress(record * 800, 1)
    monkeypatch.setattr(warc, "PIECE", 1 << 20)
    tracemalloc.start()
    n = sum(r["kind"] == "record" for r in salvage(member))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 800 and held < 20 << 20


def test_quoted_records_are_not_taken_for_records(spark, tmp_path):
    """Page 1 quotes a whole record of page 99; its own record is damaged in each way."""
    quoted = list(salvage(archive(spark, tmp_path, 3)))
    data = archive(spark, tmp_path / "b", 1)
    inner = data.replace(b"urn:page:0", b"urn:page:99")
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()

    def record(page, body, digest=None, more=0):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Payload-Digest: {digest or sha(body)}\r\nContent-Length: {len(block) + more}\r\n\r\n".encode()
        return head + block + b"\r\n\r\n"

    tail = record(2, b"sound")
    ids = lambda x: [(r["page_id"], r["reason"]) for r in salvage(x) if r["kind"] == "record"]
    body = b"<p>\r\n" + inner + b"</p>"
    assert len(quoted) == 3 and ids(record(1, body) + tail) == [(1, None), (2, None)]
    assert ids(record(1, body, sha(b"other")) + tail) == [(2, None)]
    doubt = "may lie inside a damaged record"
    assert ids(record(1, body, more=7) + tail) == [(99, doubt), (2, doubt)]
    assert ids(record(1, body).replace(b"WARC/1.1", b"WARC/?.?", 1) + tail) == [(99, doubt), (2, doubt)]
    whole = record(1, body, sha(b"other")) + tail
    assert sum(r["length"] for r in salvage(whole)) == len(whole)


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "u", "x" * 70_000 + str(i)) for i in range(150)] + [(1000 + i, "u", f"small {i}") for i in range(1200)] + [(5000, "u", "y" * 1_200_000)]
    write_warc(pages(spark, rows).coalesce(1), str(tmp_path / "w"))
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert max(sizes) < 64 * 71_500 and len(sizes) >= 6
    got = read_warc(spark, str(tmp_path / "w"), payloads=False).collect()
    assert sorted(r["page_id"] for r in got) == sorted(i for i, *_ in rows) and {r["kind"] for r in got} == {"record"}
    write_warc(pages(spark, []), str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0


def test_many_gzip_members_take_linear_time():
    sha1 = lambda x: "sha1:" + hashlib.sha1(x).hexdigest()
    took = []
    for n in (1000, 4000):
        data = b"".join(gzip.compress(foreign(i, sha1)) for i in range(n))
        began = time.process_time()
        assert sum(r["kind"] == "record" for r in salvage(data)) == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5
