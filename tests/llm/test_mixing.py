import random
from collections import defaultdict

import pytest
from conftest_llm import tokens

from gridlark.llm import mixing


def level(sizes):
    """Targets by handing out the excess until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, shares = total - sum(fixed.values()), sum(weight[s] for s in order if s not in fixed)
        over = [s for s in order if s not in fixed and rest * weight[s] / shares > 3 * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / shares for s in order if s not in fixed}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_words(docs, rows):
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == len(rows)
    sizes, source = defaultdict(int), defaultdict(set)
    for r in rows:
        sizes[r[3]] += len(tokens(r[1]))
        source[r[0]].add(r[3])
    want = level(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if len(source[r.doc_id]) == 1:
            s = next(iter(source[r.doc_id]))
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
            taken[s] += r.taken
    for s in want:
        if None not in source or s is not None:
            assert taken[s] == pytest.approx(want[s], abs=2)


def test_again_and_in_other_partitions(docs):
    a = sorted(map(str, mixing.mixed_sizes(docs).collect()))
    assert a == sorted(map(str, mixing.mixed_sizes(docs.repartition(3)).collect()))


def test_stage_gives_the_words(docs):
    want = mixing.mixed_sizes(docs).groupBy().sum("taken").first()[0]
    mix = mixing.stage(docs)
    assert mix.columns == docs.columns
    assert sum(len(tokens(r.text)) for r in mix.collect()) == want


def test_no_words(spark, no_docs):
    assert mixing.mixed_sizes(no_docs).collect() == []
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mixed_sizes(none).collect()] == [(0, 0.0, 0)] * 2


def test_weights_favour_quality(spark):
    good, bad = "a plain line of words " * 20, "### $$$ %%% *** " * 25
    rows = [(k, (good, bad)[k % 2], "s") for k in range(400)] + [(1000, "pad " * 100_000, "t")]
    got = mixing.mixed_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 4))
    part = got.filter("doc_id < 400").selectExpr("doc_id % 2 bad", "taken / size t").groupBy("bad").avg("t")
    share = {r[0]: r[1] for r in part.collect()}
    assert share[0] >= share[1]


def test_draw_by_brute_force(spark):
    """Which documents the draw takes: keys sorted in each source, words summed up to the target."""
    rng = random.Random(6)
    rows = [(k, " ".join("w" for _ in range(rng.choice((1, 2, 5, 40, 200)))), ("a", "b", "c", None)[min(3, int(rng.expovariate(0.9)))]) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    keys = {r.doc_id: r for r in mixing.drawn(df, "source", "text", "doc_id", 7).collect()}
    sizes = defaultdict(int)
    for r in keys.values():
        sizes[r.source] += r.size
    goal, want = level(dict(sizes)), {}
    for s in sizes:
        epochs = min(3, int(goal[s] // sizes[s]))
        left = 0 if epochs == 3 else round(goal[s] - epochs * sizes[s])
        for r in sorted((r for r in keys.values() if r.source == s), key=lambda r: (r.key, r.doc_id)):
            part = min(r.size, left)
            want[r.doc_id] = epochs * r.size + part
            left -= part
    got = {r.doc_id: r.taken for r in mixing.mixed_sizes(df).collect()}
    assert got == want


def test_no_bin_is_full(spark):
    """Low weights of short texts spread over bins like others."""
    df = spark.range(20_000).selectExpr("id doc_id", "'###' text", "'s' source")
    bins = mixing.drawn(df, "source", "text", "doc_id", 7).groupBy("bin").count()
    assert bins.agg({"count": "max"}).first()[0] <= 40
