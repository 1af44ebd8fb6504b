"""run() of the pipeline against the same five steps told again in plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from lorespark.llm import bpe
from lorespark.llm.mixing import SEED
from lorespark.llm.queries import ORACLE_SQL, QUERIES


def base_fails(text):
    w = (text or "").encode().split()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit |= set(range(i, i + 5))
    return len(w) < 10 or 100 * len(hit) > 20 * len(w)


def near_kept(rows):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j]) if i < j else 0
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [r for r in rows if root(r[0]) == r[0]]


def brute(rows):
    rows = [r for r in rows if not base_fails(r[1])]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append(r)
    rows = near_kept([min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()])
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.encode())
    weight = {s: n**0.5 for s, n in size.items()}
    out = Counter()
    coder = bpe._tokenizer(bpe.tokenizer_path())
    for i, t, s in rows:
        rate = sum(size.values()) * weight[s] / (sum(weight.values()) * size[s])
        u = int(hashlib.md5(f"{SEED}:{i}".encode()).hexdigest()[:12], 16) / 2**48
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        ids = coder.encode(t, add_special_tokens=False).ids
        out[i, len(ids), hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += k
    return +out


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(5, 90))) for _ in range(120)]
    for t in texts[:25]:
        w = t.split()
        w[rng.randrange(len(w))] = "Edited!"
        texts.append(" ".join(w))
    texts += [t.replace(" ", "\n ") for t in texts[30:50]] + ["same line of junk here " * 9, None, "", "short text"]
    rng.shuffle(texts)
    rows = [(i, t, ("a", "b", "c")[i % 3 if i % 5 else 0]) for i, t in enumerate(texts)]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 100, 3)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_quality_stage_with_enough_labels_for_cutoffs(spark, tmp_path):
    """1,100 good labels give en cutoffs of its own; de, with 100, takes the pool's."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    good = [(i, text(i), "en" if i < 1100 else "de") for i in range(1200)]
    junk = [(5000, text(5000) + " " + "#" * 60, "en"), (5001, text(5001) + " " + "#" * 60, "de"), (5002, text(5002), "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in good + junk], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for n, lost in ((1200, {5000, 5001}), (100, set())):
        path = tmp_path / str(n)
        spark.createDataFrame([(i, 1, 0) for i, *_ in good[:n]], "doc_id bigint, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
        kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, str(path)).collect()}
        assert kept == {i for i, *_ in good + junk} - lost


def test_run_of_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_and_registrations():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "bpe"]
    assert sorted(int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
