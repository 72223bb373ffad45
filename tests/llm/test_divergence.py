"""The audit of sources against a brute-force version in Python integers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from gridlark.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, k=200, min_docs=3):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall(text.translate(_FOLD))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        groups = {s: {t: n for t, n in c.items() if t in kept} for (x, s), c in count.items() if x == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)
        rate = lambda c, t, n: 1 + 10**9 * (c.get(t, 0) + 1) // (n + len(kept))
        p = {s: {t: rate(c, t, sum(c.values())) for t in kept} for s, c in groups.items()}
        q = {t: rate(whole, t, sum(whole.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            sources = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            items = [(f(p[s][t], q[t]), t) for t in groups[s] if p[s][t] > q[t]]
            for part, found in (("pair", sources), ("term", items)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[: k if part == "term" else None])]
    return sorted(out)


def _rows(seed=3, n=400):
    rng = random.Random(seed)
    word = lambda s: rng.choice(["Alpha", "beta", "Gamma", "été", "日本", "ß", "x"]) + f"-{'abcdefgh'[rng.randrange(8)] * rng.randrange(1, 4)}" + (f" own{s}" if s and rng.random() < 0.3 else "")
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", "é", None])
        out.append((lang, source, " ".join(word(source) for _ in range(rng.randrange(0, 40)))))
    out += [("fr", "s1", "nothing kept here"), ("fr", "s2", None), ("it", "alone", "uno due tre"), ("en", "empty", ""), ("en", "s1", "Alpha " * 30_000)]
    return out + [out[0]] * 5


@pytest.mark.parametrize("k", [3, 200])
def test_whole_result(spark, k):
    rows = _rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "lang string, source string, text string, term string").repartition(4)
    got = sorted(map(tuple, D.audit(docs, k=k).collect()))
    assert got == brute(rows, k)


def test_many_ties_and_terms(spark):
    # every term has the same counts: all bounds tie with the k-th value, and the smaller terms win
    rows = [("en", f"s{k % 2}", " ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}{'ab'[k % 2]}" for i in range(500))) for k in range(6)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, D.audit(docs, k=7).collect())) == brute(rows, 7)


def test_portions_and_nothing(spark, docs, rows, no_docs, monkeypatch):
    monkeypatch.setattr(D, "_HELD", 50)
    assert sorted(map(tuple, D.audit(docs).collect())) == brute([(r[2], r[3], r[1]) for r in rows])
    assert D.audit(no_docs).collect() == []


def test_probabilities_stay_exact_beyond_longs(spark):
    from pyspark.sql import functions as F

    cases = [(0, 7, 3), (8_999_999_999, 10**13, 5), (9_000_000_001, 10**13 + 7, 10**6), (10**15, 3 * 10**15, 10**9)]
    df = spark.createDataFrame(cases, "n long, total long, kept long").select(D.probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (n + 1) // (t + k) for n, t, k in cases]


def test_bounds_leave_buckets_unseen(spark, monkeypatch):
    """Only buckets whose bound reaches the k-th value are evaluated."""
    rng = random.Random(8)
    rows = [("en", f"s{rng.randrange(3)}", " ".join(f"w{''.join(chr(97 + int(c)) for c in str(int(rng.paretovariate(0.5)) % 5000))}" for _ in range(80))) for _ in range(300)]
    made, waves = [], []
    hinted, checkpointed = D.hinted, D.checkpointed

    def noting_waves(df, *more):
        out = hinted(df, *more)
        waves.extend([out[1]] if "place" in df.columns else [])
        return out

    def noting_buckets(df):
        out = checkpointed(df)
        made.extend([out.count()] if "bound" in df.columns else [])
        return out

    monkeypatch.setattr(D, "hinted", noting_waves)
    monkeypatch.setattr(D, "checkpointed", noting_buckets)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, D.audit(docs, k=5).collect())) == brute(rows, 5)
    assert len(made) == 1 and 0 < sum(waves) < made[0] / 2
