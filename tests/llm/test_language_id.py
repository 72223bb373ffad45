import random
import zlib

import numpy as np

from gridlark.llm import language_id as L

SYLLABLES = {
    "aa": ["ka", "to", "mi", "ra", "su"],
    "ab": ["ka", "to", "mi", "re", "so"],
    "ba": ["sch", "ung", "ein", "ich", "ß"],
    "bb": ["sch", "ung", "oen", "och", "ö"],
    "cc": ["漢", "字", "語", "文"],
}


def _text(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def test_held_out_accuracy_and_contract(spark):
    rng = random.Random(1)
    rows = [(k, _text(rng, lang, rng.randint(5, 60)), lang, "x") for k, lang in enumerate(sorted(SYLLABLES) * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").repartition(4)
    got = L.identified(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and sum(r.lang_pred == rows[r.doc_id][2] for r in held) >= 0.97 * len(held)


def test_held_out_rows_teach_nothing(spark):
    rng = random.Random(2)
    rows = [(k, _text(rng, "aa" if k % 2 else "ba"), "aa" if k % 2 else "ba") for k in range(120)]
    wrong = [(k, t, "zz" if zlib.crc32(str(k).encode()) % 3 == 1 else lang) for k, t, lang in rows]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(3, "doc_id")
    told = lambda r: sorted((x.doc_id, x.lang_pred) for x in L.identified(frame(r)).collect())
    assert told(rows) == told(wrong)


def test_odd_rows(spark, docs, rows, no_docs):
    got = L.identified(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id) if r.doc_id is not None else None
        if r.doc_id is not None:
            assert r.lang_pred == ("en" if L.has_letter(text) else "und") and r.score == (1.0 if L.has_letter(text) else 0.0)
    assert L.identified(no_docs).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (None, "12 34", "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.identified(unlabelled).collect()} == {("und", 0.0)}


def test_sample_is_bounded_and_repeats_count_once(spark):
    rows = [("en", f"word{k % 50} text") for k in range(1000)] + [("de", f"wort{k}") for k in range(500)]
    got = L.sample(spark.createDataFrame(rows, "lang string, text string"), most=60, each=100).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 30, "de": 30}


def test_vectors_of_long_texts_are_those_of_the_whole(monkeypatch):
    text = _text(random.Random(3), "ab", 400)
    whole = L.vector(text)
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(L, "_PIECE", size)
        assert np.allclose(L.vector(text), whole)
    assert not L.vector(None).any() or np.isclose(np.linalg.norm(L.vector(None)), 1)


def test_families_join_close_languages():
    unit = lambda *x: np.array(x, float) / np.linalg.norm(x)
    means = {"a": unit(1, 0.1, 0), "b": unit(1, 0, 0.1), "x": unit(0, 0.1, 1), "y": unit(0.1, 0, 1)}
    assert L.families_of(means) == [["a", "b"], ["x", "y"]]
    assert L.families_of({"a": unit(1, 0)}) == [["a"]]


def test_machine_separates_and_respects_the_box():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(1, 0.3, (40, 5)), rng.normal(-1, 0.3, (160, 5))]).astype(np.float32)
    y = np.array([1] * 40 + [-1] * 160)
    w = L.machine(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).all()
