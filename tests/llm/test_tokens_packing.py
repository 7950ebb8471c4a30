import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from threadloom.llm import _bpe, packing, queries, tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def _texts(n, seed=1):
    rnd = random.Random(seed)
    parts = ["a", "s", "t", "re", "ll", "'", "''", " ", "  ", "\n", "\t", " ", "　", "1", "22", "é", "ß", "日本", "!", "?..", "😀", "'s", "<|endoftext|>", "d", "m", "\r\n", "x", "\x1c", "½"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_encoder_gives_the_librarys_ids(library):
    from threadloom.llm._arrow import text_buffers
    import pyarrow as pa

    texts = [*_texts(4000), "word " * 400_000, "x" * 3000, ""]
    raw, offs = text_buffers(pa.array(texts))
    counts, ids = _bpe.load(queries.tokenizer_path()).encode(raw, offs, True)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_counts(spark, library):
    texts = [*_texts(300, 2), None, "", "same", "same"]
    df = spark.createDataFrame([(i if i != 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = tokens.count_tokens(df, queries.tokenizer_path(), limit=3).collect()
    want = [(i if i != 5 else None, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert sorted(map(str, ((*r[:3], r[3]) for r in got))) == sorted(map(str, ((*w, w[2] > 3) for w in want)))
    assert tokens.count_tokens(df.limit(0), queries.tokenizer_path()).count() == 0


def test_other_libraries(spark):
    df = spark.createDataFrame([(1, "Hello there, friend"), (2, None)], "doc_id long, text string")
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, queries.tokenizer_path(name)).collect()}
        assert got[1] >= 3 and got[2] == 0


def _check_packing(pieces, docs, library, window):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {d for d, _ in docs}
    for doc, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    assert sum(sum(p.length for p in s) < window for s in by_seq.values()) <= 1
    return by_seq


@pytest.mark.parametrize("targets", [None, {"a": 1.0, "b": 1.0, "c": 1.0}])
def test_packing_is_whole_and_keeps_the_mixture(spark, library, targets):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma delta"]) for _ in range(rnd.randint(0, 80))) if i % 17 else None) for i in range(400)]
    source = {i: "a" if i % 3 == 0 else rnd.choice(["b", "c", None]) for i, _ in docs}
    df = spark.createDataFrame([(i, t, source[i], 5) for i, t in docs], "doc_id long, text string, source string, length int")
    pieces = packing.pack(df.repartition(5), queries.tokenizer_path(), window=128, targets=targets).collect()
    by_seq = _check_packing(pieces, docs, library, 128)
    if targets is None:
        total = sum(p.length for p in pieces)
        share = {s: sum(p.length for p in pieces if source[p.doc_id] == s) / total for s in set(source.values())}
        for k in sorted(by_seq)[:-2]:
            for s, x in share.items():
                assert abs(sum(p.length for p in by_seq[k] if source[p.doc_id] == s) - 128 * x) <= 2 * len(share)


def test_packing_many_small_sources(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    docs = [(i, f"text {i} " * (i % 5)) for i in range(60)]
    df = spark.createDataFrame([(i, t, f"s{i % 11}") for i, t in docs], "doc_id long, text string, source string")
    _check_packing(packing.pack(df, queries.tokenizer_path(), window=64).collect(), docs, library, 64)


def test_packing_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert packing.pack(df, queries.tokenizer_path()).count() == 0


def test_packing_query(spark, sf_dir, library):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect()]
    _check_packing(queries.op8_mixture_packing(spark, sf_dir).collect(), docs, library, 1024)
