import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridlark.llm import pii
from gridlark.llm.tagger import Tagger, symbols

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def test_patterns_match_plain_regular_expressions():
    rng = random.Random(4)
    pieces = ["a", "B", "@", ".", "-", "_", " ", "  ", "+", "(", ")", "1", "23", "255", "256", "007", "4111111111111111", "é", "\n", "x.y", "a@b.c", "1.2.3.4", "+1 (743) 555-3824", "4111 1111 1111 1111"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.patterns(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000, "1 " * 150_000):
        pii.patterns(text)


def test_gradient():
    rng = np.random.default_rng(0)
    m = Tagger.fresh(5, 4, 3)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    x, y = rng.integers(0, 100, (6, 3)), rng.integers(0, 5, (6, 3))
    _, grad = m.loss_and_gradient(x, y)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = m.p[name][at], 1e-5
        m.p[name][at] = old + eps
        up = m.loss_and_gradient(x, y)[0]
        m.p[name][at] = old - eps
        down = m.loss_and_gradient(x, y)[0]
        m.p[name][at] = old
        assert g[at] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-6), name


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(1)
    m = Tagger.fresh(3, 4, 3)
    m.p["trans"] = rng.standard_normal((3, 3)).astype(np.float32)
    x = rng.integers(0, 100, (5, 2))
    em, _ = m.emissions(x)
    for n in range(2):
        score = lambda p: sum(em[t, n, p[t]] for t in range(5)) + sum(m.p["trans"][a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert tuple(m.decode(x)[:, n]) == max(np.ndindex(*[3] * 5), key=score)


def test_held_out_accuracy(model):
    x, y = pii.labelled_windows(400, seed=77)
    got = model.decode(x)
    assert (got == y)[y > 0].mean() > 0.95
    assert (got[y == 0] > 0).mean() < 0.01


def test_windows_cover_every_trigger():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abc d" * 8 + "1@") for _ in range(rng.randint(0, 400)))
        starts = pii.windows_of(text)
        assert starts == sorted(set(starts))
        last = max(0, -(-(len(text) - pii.WINDOW) // pii.STRIDE))
        want = [k * pii.STRIDE for k in range(last + 1) if pii._TRIGGER.search(text[k * pii.STRIDE : k * pii.STRIDE + pii.WINDOW])]
        assert set(want) == set(starts)


def test_query(spark, docs, rows, model):
    texts = [r[1] for r in rows]
    more = ["call (555) 010-2234 now or jane [at] mail [dot] org", "see 10[.]0[.]0[.]1 and a.b@c.de, +1 (743) 555-3824", "4111 1111 1111 1111 " * 400, "plain prose only"]
    table = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts + more)], "doc_id long, text string, spans string").repartition(4)
    got = {r.doc_id: r for r in pii.personal_data(table, model).collect()}
    assert len(got) == len(texts + more)
    for k, t in enumerate(texts + more):
        b = brute(t or "")
        plain = ",".join(f"{n}:{s}:{e}" for n in pii.KINDS for s, e in b[n])
        r = got[k]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(b[n]) for n in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        every = [x for x in r.spans.split(",") if x]
        assert set(filter(None, plain.split(","))) <= set(every)
        assert every == sorted(every, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))
    assert got[len(texts)].spans == "email:27:51,phone:5:19"
    assert "ip:4:18" in got[len(texts) + 1].spans
    assert got[len(texts) + 3].spans == ""


def test_empty(no_docs, model):
    assert pii.personal_data(no_docs, model).collect() == []


def test_symbols():
    assert symbols("aé•\U0001f600").tolist() == [100, 2, 1, 1]


class Marked:
    """Tags a span's letters, y as its start, by what a window shows."""

    def decode(self, x):
        start, *inner = symbols("yx@.")
        return np.where(x == start, 1, np.where(np.isin(x, inner), 2, 0)).astype(np.uint8)


@pytest.mark.parametrize("size", [50, 60, 76, 96, 150, 400])
def test_long_spans_are_whole_at_every_offset(size, monkeypatch):
    monkeypatch.setattr(pii, "patterns", lambda text: {k: [] for k in pii.KINDS})
    span = "y" + "x" * (size - 6) + "@x.xx"
    texts = ["A " * (n // 2) + " " * (n % 2) + span + " A" * 100 for n in range(200)]
    table = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = list(pii._scanned(Marked())(iter([table])))
    assert out[0].column(6).to_pylist() == [f"email:{n}:{n + size}" for n in range(200)]


def test_spaced_at_is_a_trigger():
    assert pii.windows_of("jane [ at ] mail [ dot ] org") == [0] and pii.windows_of("jane at mail dot org") == []
