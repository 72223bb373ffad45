import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridlark.llm import packing
from gridlark.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


def pieces_are_right(docs, rows):
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    got = packing.packed(docs, tokenizer_path()).collect()
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(t.encode(r[1] or "", add_special_tokens=False).ids + [2])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == want.keys()
    for i, lists in want.items():
        # repeated rows and null ids: pieces match the texts as a multiset
        left = sorted(by_doc[i])
        for ids in lists:
            at = 0
            while at < len(ids):
                crc = lambda n: zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())  # noqa: B023, E731
                piece = next(p for p in left if p[0] == at and p[3] == len(ids) and p[2] == crc(p[1]))
                left.remove(piece)
                at += piece[1]
            assert at == len(ids)
        assert not left
    for places in by_seq.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 4096
    used = [sum(n for _, n in p) for p in by_seq.values()]
    return sum(used), sum(n if n & (n - 1) == 0 else 4096 for n in used)


def test_pieces(docs, rows):
    pieces_are_right(docs, rows)


def test_little_padding(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([30, 700, 1000, 3000, 5000])))) for k in range(400)]
    used, padded = pieces_are_right(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows)
    assert padded - used <= 0.02 * used + 4096


def test_empty(no_docs):
    assert packing.packed(no_docs, tokenizer_path()).collect() == []


def test_nnls_finds_an_exact_mixture():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, (20, 60)).astype(float)
    x = np.where(rng.random(60) < 0.1, rng.integers(1, 9, 60), 0).astype(float)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)


def test_plan_places_every_rest_once():
    rng = random.Random(2)
    histogram = {rng.randint(1, 4095): rng.randint(1, 60) for _ in range(500)} | {3000: 2000}
    at, filled = packing.plan(histogram), defaultdict(list)
    for length, n in histogram.items():
        for rank in range(n):
            for _, m, seq, off in at.pieces(length, rank):
                filled[seq].append((off, m))
    for places in filled.values():
        end = 0
        for off, m in sorted(places):
            assert off == end
            end += m
        assert end <= 4096
    total = sum(k * n for k, n in histogram.items())
    assert sum(m for p in filled.values() for _, m in p) == total
    assert len(filled) * 4096 <= total * 1.01 + 4096


def test_ids_of_pieces_are_those_of_texts():
    rng = random.Random(6)
    parts = ["Ab", "x", "é", "Ç", "İ", "ß", ".", ",", "!!", "...", "'s", "'", "12", " ", "\n", "\t", "\x1c", "\u00a0", "e\u0301", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "漢字", "\U0001f600", "²"]
    texts = [None, "", " "] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    ids = packing.WordIds(tokenizer_path(), most=500)
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids, ids.kind).tobytes() for x in texts]
    got = []
    for start, n in packing.portions(pa.array(texts), 2000):
        got += ids.encoded(pa.array(texts).slice(start, n))
    assert got == want
