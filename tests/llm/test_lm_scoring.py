import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import tokens

from gridlark.llm import lm_scoring, ppm
from gridlark.llm.lm_scoring import _merged


class Brute:
    """Prediction by partial matching with dictionaries, byte by byte."""

    def __init__(self, texts, least=1):
        grams = Counter()
        for t in texts:
            data = b"\0" * ppm.ORDER + t + b"\0"
            for k in range(ppm.ORDER, len(data)):
                for o in range(ppm.ORDER + 1):
                    grams[data[k - o : k], data[k]] += 1
        self.after = defaultdict(dict)
        for (c, s), n in grams.items():
            if n >= least:
                self.after[c][s] = n
        self.nodes = [(len(c), int.from_bytes(c + bytes([s]), "big"), n) for c, f in self.after.items() for s, n in f.items()]

    def log10(self, context, symbol):
        out, gone = 0.0, set()
        for k in range(len(context) + 1):
            seen = self.after.get(context[k:])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in gone}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / total)
            if left:
                out += math.log10(len(left) / total)
            gone = set(seen)
        return out - math.log10(256 - len(gone))

    def score(self, text):
        data = b"\0" * ppm.ORDER + text + b"\0"
        return sum(self.log10(data[k - ppm.ORDER : k], data[k]) for k in range(ppm.ORDER, len(data)))


TEXTS = [b"the cat sat on the mat", b"the dog sat on the log", b"", b"a cat and a dog", bytes(range(1, 200))]


@pytest.mark.parametrize("least", [1, 2])
def test_model_matches_dictionaries(least):
    brute = Brute(TEXTS, least)
    model = ppm.Model(*(np.array(c) for c in zip(*brute.nodes)))
    new = [b"the cat and the dog", b"", b"zzz\xff\xfe", b"the the the", b"\0\0a"]
    assert np.allclose(model.scores(new), [brute.score(t) for t in new])


def test_probabilities_add_up_to_one():
    model = ppm.Model(*(np.array(c) for c in zip(*Brute(TEXTS, 2).nodes)))
    for context in (b"e cat", b" sat ", b"\0\0\0\0\0", b"qqqqq", b"qq th"):
        windows = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10 ** model.costs(windows)).sum() == pytest.approx(1)


def test_windows_of_long_texts_are_the_same():
    t = bytes(np.random.default_rng(1).integers(97, 110, 5000).astype(np.uint8))
    whole = np.concatenate([w for w, _ in ppm.grams([b"x", t, b"yy"])])
    parts = list(ppm.grams([b"x", t, b"yy"], chunk=700))
    assert (np.concatenate([w for w, _ in parts]) == whole).all()
    assert np.bincount(np.concatenate([o for _, o in parts])).tolist() == [2, 5001, 3]


def brute_base(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    train = Counter()
    for i, t, *_ in rows:
        if not held(i):
            train.update(tokens(low(t)))
            train[None] += 1
    n, v = sum(train.values()), len(train)
    out = []
    for i, t, *_ in rows:
        found = tokens(low(t)) + [None]
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in found)
        out.append((str(i), held(i), len(found), sum(train[w] > 0 for w in found), n, round(base, 4)))
    return sorted(out)


@pytest.mark.parametrize("words", [lm_scoring.MOST_WORDS, 20])
def test_base_matches_brute_force(docs, rows, words):
    got = lm_scoring.scored(docs, most_words=words).collect()
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == brute_base(rows)


def test_score_is_that_of_the_trie(spark):
    rows = [(k, TEXTS[k % 4].decode()) for k in range(40)]
    train = [t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    brute = Brute(train)
    got = lm_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert all(r.score == pytest.approx(brute.score(dict(rows)[r.doc_id].encode())) for r in got)


@pytest.mark.parametrize("most", [0, 20])
def test_nothing_of_the_trie_is_left_out(spark, most):
    rng = np.random.default_rng(3)
    rows = [(k, "".join(chr(c) for c in rng.choice([97, 98, 99, 100, 32, 228], 30))) for k in range(60)] + [(61, None), (62, "")]
    train = [(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    brute = Brute(train)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_scoring.scored(df, most_nodes=most).collect()
    assert len(got) == len(rows) and any(r.held_out for r in got)
    assert all(r.score == pytest.approx(brute.score((dict(rows)[r.doc_id] or "").encode())) for r in got)


def test_nothing_to_learn_from(spark, no_docs):
    assert lm_scoring.scored(no_docs).collect() == []
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm_scoring.scored(spark.createDataFrame([(one, "ab")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 2) and r.score == pytest.approx(-3 * math.log10(256))


def test_counts_given_out_early():
    c = lm_scoring._Counts(7, most=50)
    out = [b for k in range(20) for b in c.add(np.arange(k, k + 30, dtype=np.uint64))] + list(c.out())
    total = Counter()
    for b in out:
        total.update(dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist())) if len(b) else {})
    want = Counter(x for k in range(20) for x in range(k, k + 30))
    assert total == want
    assert _merged([(np.array([3, 1]), np.array([1, 2])), (np.array([3]), np.array([4]))])[1].tolist() == [2, 5]


@pytest.mark.parametrize("most", [1, 7, 50, 10_000])
@pytest.mark.parametrize("size", [1, 5, 1000])
def test_portions_hold_whole_contexts(most, size):
    rng = np.random.default_rng(most + size)
    context = np.sort(np.r_[rng.integers(0, 12, 200), np.full(150, 5)])
    values = context << 8 | rng.integers(0, 256, 350)
    columns = [rng.integers(3, 6, 350).astype("i4"), values, np.arange(350), np.arange(350)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + size]) for c in columns], names=list("ovnm")) for k in range(0, 350, size)]
    parts = list(lm_scoring._by_context(iter(batches), most))
    assert all((np.concatenate([p[k] for p in parts]) == columns[k]).all() for k in range(4))
    found = [set((p[1] >> 8).tolist()) for p in parts]
    assert all(not a & b for k, a in enumerate(found) for b in found[k + 1 :])
    assert max(len(p[0]) for p in parts) <= max(most + size, 2 * 200 + size)
    assert list(lm_scoring._by_context(iter([]), most)) == []
