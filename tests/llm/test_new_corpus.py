"""Fill-in-the-middle, exact top-k search and tokenizer alignment against brute force, and the odd inputs that they define."""

import hashlib
import math
import random
import re
from bisect import bisect_right
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from caseloom.llm import alignment, fill_in_middle, top_k

DATA = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill in the middle


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest, n = sha(f"1:{'null' if doc_id is None else doc_id}"), len(units)
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return doc_id, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_in_middle_equals_a_plain_loop(spark):
    r = random.Random(8)
    texts = [None, "", " ", "a", "<P>", "x <S> y", "<", "<<S", "P>M>S>", "é漢😀\n\r\n\t\0é", "word " * 60_000, "z" * 200_000, "<p>" * 50]
    texts += ["".join(r.choice("ab <>PSM\n😀é1") for _ in range(r.randrange(30))) for _ in range(400)]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (3, "a"), (3, "a"), (3, "other text")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for c in ("units", "n", "form", "h1", "low", "id", "output"):
        docs = docs.withColumn(c, F.lit("clash"))
    made = fill_in_middle.transformed(docs)
    got = sorted((tuple(x) for x in fill_in_middle.digests(made).collect()), key=repr)
    want = sorted((brute_fim(*x) for x in data), key=repr)
    assert got == want and {x[2] for x in want} == {"plain", "psm", "spm"}
    assert fill_in_middle.digests(fill_in_middle.transformed(docs.limit(0))).count() == 0


def test_fill_in_middle_is_native(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = fill_in_middle.digests(fill_in_middle.transformed(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# exact top-k


def brute_top(rows, k, queries=lambda i: i % 20 == 0):
    """(query id, rank, id, score) of (id, vector) rows by all inner products."""
    held = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (qid, qv) in enumerate(held):
        if qid is None or not queries(qid):
            continue
        scored = [(-sum(a * b for a, b in zip(qv, v, strict=False)), i is None, i or 0, at) for at, (i, v) in enumerate(held) if at != q]
        out += [(qid, rank + 1, None if none else i, -score) for rank, (score, none, i, _) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, rows, k=20, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    for c in ("id", "vector", "row", "score", "members", "least", "query"):
        df = df.withColumn(c, F.lit("clash"))
    return sorted((tuple(r) for r in top_k.top_k(df, F.col("id") % 20 == 0, k, **more).collect()), key=repr)


@pytest.mark.parametrize("lists", [1, 4, 9])
def test_top_k_equals_brute_force(spark, lists):
    r = random.Random(lists)
    rows = [(i, [r.gauss(0, 1) / 8 for _ in range(8)]) for i in range(700)]
    assert found(spark, rows, 10, lists=lists) == brute_top(rows, 10)
    assert found(spark, rows, 10, lists=lists, block_bytes=200) == brute_top(rows, 10)


def test_top_k_with_ties_copies_and_a_hot_vector(spark):
    """A third of the rows share one vector; scores are few, so most ranks are decided by ties; ids and whole rows repeat."""
    r = random.Random(5)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(600)]
    rows += [(1000 + i, [1.0, 1.0, 0.0, -1.0]) for i in range(300)] + [(20, [1.0, 1.0, 0.0, -1.0])] * 5 + [(None, [1.0, 1.0, 1.0, -1.0])] * 3
    assert found(spark, rows) == brute_top(rows, 20)


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan")]), (4, [float("inf"), 1.0]), (20, []), (40, [5.0]), (5, [1.0, 1.0, 7.0]), (60, [-0.001, -2.0, 1.0]), (80, [30_000.0, 1.0])]
    assert found(spark, rows) == brute_top(rows, 20)
    assert found(spark, rows, 2) == brute_top(rows, 2)
    assert found(spark, [(20, [1.0])]) == [] and found(spark, [(1, [1.0])]) == [] and found(spark, []) == []
    big = [(20, [3e7, 3e7, 0.0, 0.0]), (21, [-3e7, -3e7, 0.0, 0.0]), (22, [2.9e7, 2.9e7, 1.0, 0.0])]
    assert found(spark, big) == brute_top(big, 20)


def test_top_k_sends_few_rows(spark):
    """What leaves a task is bounded by queries times k, not by pairs."""
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) + 3 * (i % 3 == j % 3) for j in range(16)]) for i in range(4000)]  # lists of different lengths
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    sent = []
    plain = top_k._highest

    def counted(rows, *args):
        sent.append(rows.count())
        return plain(rows, *args)

    top_k._highest = counted
    try:
        top_k.top_k(df, F.col("id") % 20 == 0, 5).count()
    finally:
        top_k._highest = plain
    assert 0 < sent[0] <= 200 * 6 * 8 and sent[1] < 200 * 6 * 3


# tokenizer alignment


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return tuple(str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries(paths):
    """For a text, the bytes and ids of the tokens of both libraries over the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    alphabet = alignment._byte_of_char()

    def whole(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xs = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([i - 3]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        return x, y, xs, ys

    return whole


def brute_alignment(libraries, rows):
    """Per row, by byte ranges of all tokens: counts, and the links with their corpus-wide document counts."""
    made, holders = [], {}
    for nth, (doc_id, text) in enumerate(rows):
        x, y, xs, ys = libraries(text) if text else ([], [], [], [])
        data = (" " + text).encode() if text else b""
        if b"".join(xs) != data or b"".join(ys) != data:
            x, y, xs, ys = [], [], [], []
        ends = [list(accumulate(map(len, side))) for side in (xs, ys)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, found, i, j = [], [], 0, 0
        for end in both:
            k, m = bisect_right(ends[0], end), bisect_right(ends[1], end)
            groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
            spans = [[(e - len(t), e, n) for t, e, n in zip(side[u:v], en[u:v], ids[u:v], strict=True)] for side, en, ids, u, v in ((xs, ends[0], x, i, k), (ys, ends[1], y, j, m))]
            found += [(p, q) for s, e, p in spans[0] for c, d, q in spans[1] if s < d and c < e]
            i, j = k, m
        for pair in set(found):
            holders[pair] = holders.get(pair, 0) + 1
        made.append((doc_id, len(x), len(y), groups, found))
    best = {}
    for (p, _), n in holders.items():
        best[p] = max(best.get(p, 0), n)
    return [(d, n, m, len(g), len(f), sum(holders[x] == best[x[0]] for x in f), sum(holders[x] for x in f), sha(";".join(g)) if g else "") for d, n, m, g, f in made]


def aligned_rows(spark, rows, paths, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("id", "kind", "chunk", "group", "a", "b", "n", "times"):
        docs = docs.withColumn(c, F.lit("clash"))
    made = alignment.aligned(docs, *paths, **more)
    assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in made.collect()), key=repr)


def test_alignment_equals_brute_force(spark, paths, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = sorted(brute_alignment(libraries, rows), key=repr)
    assert aligned_rows(spark, rows, paths) == want
    assert aligned_rows(spark, rows, paths, chunk_chars=5000) == want, "chunks change nothing"


def test_alignment_of_odd_texts(spark, paths, libraries):
    r = random.Random(12)
    texts = [None, "", " ", "\n", "  \n ", "▁ mark", "a▁b c", "<|endoftext|> </s> <s>[INST]", "x\0y z", "é漢字 😀😀 naïvé ｆｕｌｌ", "a b 　c d", "a\x1c b\x85 c᠎ d", "don't we'll\r\n  go\t\tthere;\r\n", "ab " * 20_000, "z" * 30_000, "漢" * 5000]
    letters = [" ", " ", "\n", "\t", "a", "the", "é", "漢", "😀", "12", "'s", ".", "\r", " ", "　", "  ", "_", "▁", "\x1c", "​"]
    texts += ["".join(r.choice(letters[:16]) for _ in range(r.randrange(25))) for _ in range(300)]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(25))) for _ in range(200)]
    rows = [*enumerate(texts), (None, "no id"), (None, None), (3, "the same"), (3, "the same"), (3, "another")]
    want = brute_alignment(libraries, rows)
    assert aligned_rows(spark, rows, paths) == sorted(want, key=repr)
    assert aligned_rows(spark, rows, paths, chunk_chars=1) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 300 and sum(bool(t) and not w[1] for t, w in zip(texts, want, strict=False)) > 20
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), *paths).count() == 0


def test_remembered_segments_may_be_forgotten(spark, paths, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "_SEGMENTS", 3)
    aligner = alignment.Aligner(*paths)
    for text in ("one two three four five", "six seven eight", "one two"):
        chunk = alignment._Chunk(0)
        chunk.add(aligner, 1, text)
        keys = [aligner.keys[n] for n in aligner.groups(text)[0]]
        aligner.tidy()
        assert sha(";".join(keys)) == chunk.digests[0] == brute_alignment(libraries, [(1, text)])[0][-1]
    assert len(aligner.segments) <= 3 and aligner.older


def test_segments_tile_the_text():
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice([" ", " ", "\n", "\t", "a", "bc", "é", "  ", "\x1c", "\u3000"]) for _ in range(r.randrange(1, 14)))
        keys = alignment.segment_keys(text)
        assert "".join(map(alignment._full, keys)) == " " + text
