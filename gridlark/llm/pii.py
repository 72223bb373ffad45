"""Personal data in texts: exact patterns, and spans that a trained tagger adds.

Emails, ip addresses, card numbers and phone numbers that have a plain form
are found by patterns. Other written forms (an address spelt with [at], a
number without its country code, an ip with bracketed dots) come from a
character-level bidirectional LSTM with CRF transitions, trained in numpy on
labelled spans that a seeded generator writes into sentences.

Every text is covered by overlapping windows. All four kinds need a digit, an
@ or a spelt [at]; windows without any of these can't hold a span and are not
decoded, unless a tagged run goes on into them. The windows' tags are put
together over the whole text, each place's from the window in which it lies
most central, and spans of any length are read from these; they are
reconciled over the whole text, longest first,
checked for their kind, and added where no pattern's span lies. Rows are
independent, so nothing is shuffled and no text is cut.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tagger import Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Forms that an added span must have.
_GAP = r"\s?"
_AT, _DOT = r"\s?(?:@|[(\[{]\s?at\s?[)\]}])\s?", r"\s?(?:\.|[(\[{]\s?dot\s?[)\]}])\s?"
_TRIGGER = re.compile(rf"(?i)[0-9]|{_AT.removeprefix(_GAP).removesuffix(_GAP)}")
_FORMS = {
    "email": re.compile(rf"(?i)[\w.%+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:\s?[\[(]\s?\.\s?[\])]\s?[0-9]{1,3}|\s?\.\s?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ .\-/]{0,2}[0-9]){12,18}"),
    "phone": re.compile(r"(?:\([0-9]{3}\)|[0-9]{3})[ .\-/][0-9]{3}[ .\-][0-9]{4}|00[0-9]{1,3}(?:[ .\-/()]?[0-9]){7,12}"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches around each @; the local part starts as far left as the last match allows."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(free, at + 1))
    return out


def patterns(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost matches of each kind's pattern that pass its check."""
    out: dict[str, list] = {k: [] for k in KINDS}
    out["email"] = _emails(text)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                out["phone"].append(m.span())
    return out


# -- labelled spans ---------------------------------------------------------


def _card(rng: random.Random, n: int) -> str:
    body = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return body + next(c for c in "0123456789" if luhn(body + c))


def _grouped(rng: random.Random, digits: str, sep: str) -> str:
    return sep.join(digits[k : k + 4] for k in range(0, len(digits), 4))


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def example(rng: random.Random, word, kind: str) -> str:
    """A written form of the kind, plain or not."""
    if kind == "email":
        name = rng.choice([word, lambda: f"{word()}.{word()}", lambda: f"{word()}{_number(rng, 2)}", lambda: f"{word()}.{_number(rng, 2)}", lambda: word() + "é"])()
        at, dot = rng.choice([("@", ".")] * 4 + [(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", "."), (" @ ", ".")])
        host = rng.choice([word, lambda: word() + dot + "example", lambda: f"mail{_number(rng, 1)}{dot}example"])()
        return name + at + host + dot + rng.choice(["com", "org", "net", "de", "fr"])
    if kind == "ip":
        return rng.choice([".", ".", "[.]", " . ", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        return _grouped(rng, _card(rng, rng.choice([13, 14, 15, 16, 16, 16, 19])), rng.choice(["", "", " ", "-", ".", "/"]))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return rng.choice([f"+1 ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{rng.randint(1, 99)} {a} {b}{c}"])


def decoy(rng: random.Random) -> str:
    """Something with digits, an @ or brackets that is no personal data."""
    n = rng.randint(1, 4)
    return rng.choice(
        [
            lambda: _number(rng, n),
            lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}",
            lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 30)}",
            lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
            lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}",
            lambda: f"${_number(rng, n)}.{_number(rng, 2)}",
            lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"',
            lambda: f"{_number(rng, 2)}:{_number(rng, 2)}",
            lambda: f"@{_number(rng, n)} ",
            lambda: _number(rng, rng.randint(5, 11)),
            lambda: f"({rng.randint(1, 99)})",
            lambda: f"https://a.example/{_number(rng, 3)}",
        ]
    )()


def labelled_windows(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags (WINDOW, count): O is 0, a kind's first character 1 + 2k, the others 2 + 2k."""
    rng = random.Random(seed)
    parts = ["the", "er", "on", "tion", "an", "re", "es", "ou", "ci", "mente", "lich", "ung", "ée", "è", "ß", "ñ", "st", "ha"]

    def word() -> str:
        w = "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
        return rng.choice([w, w, w, w.capitalize(), w.upper()])

    x, y = np.zeros((WINDOW, count), np.uint8), np.zeros((WINDOW, count), np.uint8)
    for n in range(count):
        text, tags = "", []
        while len(text) < 2 * WINDOW:
            draw = rng.random()
            kind = rng.randrange(4) if draw < 0.16 else None
            piece = example(rng, word, KINDS[kind]) if kind is not None else decoy(rng) if draw < 0.28 else word()
            end = rng.choice([" ", " ", " ", ". ", ", ", "\n", "!! ", "%%% ", "### "])
            tags += [0 if kind is None else 2 + 2 * kind] * len(piece) + [0] * len(end)
            if kind is not None:
                tags[len(text)] = 1 + 2 * kind
            text += piece + end
        at = rng.randint(0, len(text) - WINDOW)
        size = WINDOW if rng.random() < 0.9 else rng.randint(5, WINDOW)
        x[:size, n] = symbols(text)[at : at + size]
        y[:size, n] = tags[at : at + size]
    return x, y


@lru_cache(maxsize=2)
def trained(windows: int = 4000, steps: int = 450, seed: int = 11) -> Tagger:
    """The tagger, trained once in a driver's life from labelled windows (bounded by ``windows``)."""
    model = Tagger.fresh(1 + 2 * len(KINDS))
    x, y = labelled_windows(windows, seed)
    model.fit(x, y, steps)
    return model


# -- whole texts ------------------------------------------------------------


def windows_of(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a trigger."""
    last, out, at = max(0, -(-(len(text) - WINDOW) // STRIDE)), [], 0
    while m := _TRIGGER.search(text, at):
        low = max(0, -(-(m.end() - WINDOW) // STRIDE))
        high = min(last, m.start() // STRIDE)
        for k in range(max(low, out[-1] + 1 if out else 0), high + 1):
            out.append(k)
        # go on behind what the windows so far cover
        at = max(m.end(), out[-1] * STRIDE + STRIDE) if out else m.end()
    return [k * STRIDE for k in out]


def _asked(decoded: dict[int, np.ndarray], size: int) -> list[int]:
    """Starts of windows that aren't decoded, and into which a tagged run of a decoded one goes on."""
    out = set()
    for start, tags in decoded.items():
        if start and tags[0]:
            out.add(start - STRIDE)
        if start + len(tags) < size and tags[-1]:
            out.add(start + STRIDE)
    return sorted(out - decoded.keys())


def _stitched(decoded: dict[int, np.ndarray], size: int) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the spans of a text, from the tags of its windows."""
    tags, seam = np.zeros(size, np.uint8), np.zeros(size, bool)
    edge = (WINDOW - STRIDE) // 2
    for start in sorted(decoded):
        part = decoded[start]
        low = edge if start - STRIDE in decoded else 0
        high = WINDOW - edge if start + STRIDE in decoded else len(part)
        tags[start + low : start + high] = part[low:high]
        seam[start + low] = True
    # a run that goes on over a seam is one span, whatever tag it goes on with
    at = np.flatnonzero(tags)
    kind = (tags[at].astype(int) - 1) // 2
    begins = (tags[at] % 2 == 1) & ~seam[at]
    if len(at):
        begins[0] = True
        begins[1:] |= (np.diff(at) > 1) | (kind[1:] != kind[:-1])
    first = np.flatnonzero(begins)
    last = np.r_[first[1:], len(at)][: len(first)] - 1
    return [(int(at[i]), int(at[j]) + 1, int(kind[i])) for i, j in zip(first, last)]


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in " \n\t.,;:":
        start += 1
    while end > start and text[end - 1] in " \n\t.,;:-":
        end -= 1
    return start, end


def reconciled(text: str, found: list[tuple[int, int, int]], fixed: dict) -> list[tuple[int, int, int]]:
    """The tagger's spans of a whole text: of the right form, longest first, apart from all others."""
    taken = bytearray(len(text))
    for a, b in (s for spans in fixed.values() for s in spans):
        taken[a:b] = b"\1" * (b - a)
    out: list[tuple[int, int, int]] = []
    for start, end, kind in sorted(set(found), key=lambda s: (s[0] - s[1], s)):
        start, end = _trimmed(text, start, end)
        part = text[start:end]
        if not _FORMS[KINDS[kind]].fullmatch(part):
            continue
        digits = "".join(_DIGIT.findall(part))
        if KINDS[kind] == "card" and not luhn(digits):
            continue
        if KINDS[kind] == "ip" and not all(map(_small, re.findall("[0-9]+", part))):
            continue
        inside = lambda c: c.isalnum() or c == "@"
        if start and inside(text[start - 1]) or end < len(text) and inside(text[end]):
            continue
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            out.append((start, end, kind))
    return out


def _scanned(model: Tagger):
    def flush(rows: list, pending: list) -> None:
        """Decode the pending windows of rows, and those that runs go on into; add what they find."""
        decoded: dict[int, dict[int, np.ndarray]] = {}
        while pending:
            x = np.zeros((WINDOW, len(pending)), np.uint8)
            for n, (r, start) in enumerate(pending):
                part = symbols(rows[r][1][start : start + WINDOW])
                x[: len(part), n] = part
            tags = model.decode(x)
            for n, (r, start) in enumerate(pending):
                decoded.setdefault(r, {})[start] = tags[: min(WINDOW, len(rows[r][1]) - start), n]
            hit = sorted({pending[n][0] for n in np.flatnonzero(tags.any(0))})
            pending = [(r, start) for r in hit for start in _asked(decoded[r], len(rows[r][1]))]
        for r, windows in decoded.items():
            if any(t.any() for t in windows.values()):
                rows[r][3].extend(_stitched(windows, len(rows[r][1])))

    def told(rows: list) -> pa.RecordBatch:
        out = []
        for i, text, base, found in rows:
            added = reconciled(text, found, base) if found else []
            name = lambda k, spans: [f"{k}:{a}:{b}" for a, b in sorted(spans)]
            plain = ",".join(x for k in KINDS for x in name(k, base[k]))
            every = ",".join(x for n, k in enumerate(KINDS) for x in name(k, base[k] + [s[:2] for s in added if s[2] == n]))
            out.append((i, *(len(base[k]) for k in KINDS), hashlib.sha256(plain.encode()).hexdigest(), every))
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        cols = list(zip(*out)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pending, chars = [], [], 0
            for i, t in zip(batch.column(0), batch.column(1)):
                text = t.as_py() or ""
                rows.append((i.as_py(), text, patterns(text), []))
                pending += [(len(rows) - 1, s) for s in windows_of(text)]
                chars += len(text)
                if len(pending) > 20_000:
                    flush(rows, pending)
                    pending = []
                if chars > 20_000_000:
                    flush(rows, pending)
                    yield told(rows)
                    rows, pending, chars = [], [], 0
            flush(rows, pending)
            yield told(rows)

    return run


def personal_data(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs.

    Counts and the digest are of the patterns' spans; ``spans`` has the
    tagger's too. Places are code points, ends exclusive. A null or empty
    text has no spans, and the digest of the empty string. Very long texts are
    scanned whole, window by window. Other columns are left aside, so their
    names can't clash. Repeated rows are scanned alike; an empty table gives
    an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.mapInArrow(_scanned(model or trained()), schema)
