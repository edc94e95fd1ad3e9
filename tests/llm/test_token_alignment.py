"""Links between two tokenizers' tokens against a plain count, and the hash that indexes them."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timeloom.llm import token_alignment as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def plain(texts):
    """Every figure by the libraries on whole texts, token by token."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = T.byte_letters()
    rows, holds = [], Counter()
    for t in texts:
        spans, data = [], (" " + (t or "")).encode()
        if t:
            of_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
            of_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
            if b"".join(x for _, x in of_a) == data == b"".join(x for _, x in of_b):
                for side in (of_a, of_b):
                    at, out = 0, []
                    for i, x in side:
                        out.append((i, at, at + len(x)))
                        at += len(x)
                    spans.append(out)
        if not spans:
            rows.append(([], [], [], ""))
            continue
        by_start = defaultdict(list)
        for j, s, e in spans[1]:
            for k in range(s, e):
                by_start[k].append(j)
        own_b = {k: n for n, (_, s, e) in enumerate(spans[1]) for k in range(s, e)}
        links = [(i, spans[1][n][0]) for i, s, e in spans[0] for n in sorted({own_b[k] for k in range(s, e)})]
        common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low < e <= high) for side in spans))
            low = high
        rows.append((spans[0], spans[1], links, ";".join(groups)))
        holds.update(set(links))
    best = defaultdict(int)
    for (i, _), n in holds.items():
        best[i] = max(best[i], n)
    return [(len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(holds[x] == best[x[0]] for x in links), sum(holds[x] for x in links), g) for a, b, links, g in rows]


def odd_texts():
    rng = random.Random(4)
    some = [None, "", " ", "  ", "\n", "a", " a", "a ", "\n\na \n b\t\tc", "▁", "a▁b", "<|endoftext|> and <s> </s> <unk>", "it's we'll I'M", "überßen, naïve. Ω≈ç√", "日本語のテキスト。", "👩‍👩‍👧 ok", "a.b,c;d:e!f?g", "x" * 3000,
            "1.1." * 500, " nbsp em", "\r\n\r\n", "foo  bar   baz", "....", "a .b", "\x00nul", "tab\tend\t", "ﬁ ligature ①", "end.\nNext", "é combining", "<0x41>"]
    alphabet = ["a", "B", "the", " ", "  ", "\n", ".", ",", "'s", "é", "ß", "▂", "中", "\t", "9", "-", "tion", "😀", "​", "!"]
    return some + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("max_pairs", [T.MAX_PAIRS, 500])
def test_against_whole_texts(spark, max_pairs):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + odd_texts()
    texts += texts[:20] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_a": F.lit("clash"), "lang": F.lit("en")}).repartition(4)
    got = {r["doc_id"]: r for r in T.align_tokens(docs, A, B, max_pairs=max_pairs).collect()}
    want = plain(texts)
    assert len(got) == len(texts) and all(r["lang"] == "en" for r in got.values())
    for i, w in enumerate(want):
        assert tuple(got[i][c] for c in COLUMNS) == w, repr(texts[i])[:200]
    if max_pairs == 500:
        return
    q = T.align_tokens(docs.limit(0), A, B)
    assert q.collect() == [] and set(COLUMNS) <= set(q.columns)


def test_query_digest(spark):
    import hashlib

    rows = T.op12_pair_counts(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in random.Random(1).sample(rows, 30):
        w = plain([texts[r["doc_id"]]])[0]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == w[:4] and r["groups_sha256"] == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


def test_chunks_give_whole_encodings():
    of = T.Aligner(A, B)
    assert of.split and of.quick
    rng = random.Random(9)
    for t in odd_texts()[1:] + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xC0, 0x24F), rng.randint(0x300, 0x3000)])) for _ in range(40)) for _ in range(200)]:
        (chunks,), _, known = of.align([t or ""])
        assert " ".join(chunks) == (t or "")
        if t and all(known[c] for c in chunks):
            ids = [x.split("|") for x in "".join(known[c].groups for c in chunks)[:-1].split(";")]
            assert [int(i) for g in ids for i in g[0].split(",")] == of.a.encode(" " + t, add_special_tokens=False).ids
            assert [int(i) for g in ids for i in g[1].split(",")] == of.b.encode(t)


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 1), (1, 5), (700, 3), (50_000, 7)])
def test_hash_is_minimal_and_perfect(n, parts):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**33, n + n // 50))[:n]
    part = T.MinimalHash.part(keys, parts)
    h = T.MinimalHash([T.MinimalHash.part_of(keys[part == p]) for p in range(parts)])
    assert h.n == len(keys) and np.array_equal(np.sort(h(keys)), np.arange(len(keys)))
    foreign = h(np.arange(2**40, 2**40 + 1000))
    assert ((foreign >= -1) & (foreign < max(1, n))).all()
    if n > 1:
        table = T.PairCounts(0, 2**33, 1, h, np.zeros(n, np.int64), np.zeros(n), np.zeros(n))
        table.keys[h(keys)] = keys
        assert np.array_equal(table.keys[table.places(keys)], keys)
        with pytest.raises(ValueError):
            table.places(np.array([2**40]))
    with pytest.raises(ValueError):
        T.MinimalHash.part_of(np.array([3, 3]))


def test_texts_are_read_and_aligned_once(spark, tmp_path):
    """Counts are looked up by what the first pass wrote, not by reading and encoding the texts again."""
    path = tmp_path / "docs"
    spark.createDataFrame([(1, "some words, twice"), (2, "some words"), (3, None)], "doc_id long, text string").write.parquet(str(path))
    found = T.align_tokens(spark.read.parquet(str(path)), A, B, keep=["doc_id"])
    for f in path.glob("*.parquet"):
        f.unlink()
    assert found.columns == ["doc_id", *COLUMNS]
    assert [tuple(r[c] for c in COLUMNS) for r in found.orderBy("doc_id").collect()] == plain(["some words, twice", "some words", None])
