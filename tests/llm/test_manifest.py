"""The manifest against a recursive version in hashlib."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from gridlark.llm import manifest as M


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])


def _tree(nodes):
    """(root, path of (left, right) for each node)."""
    paths, places, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        for k, at in enumerate(places):
            first = at - at % 3
            paths[k].append(("".join(now[first:at]), "".join(now[at + 1 : first + 3])))
        now = [_h(*now[i : i + 3]) for i in range(0, len(now), 3)]
        places = [at // 3 for at in places]
    return now[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    key = lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, _leaf(r))
    groups = [list(g) for _, g in groupby(sorted(rows, key=key), key=lambda r: r[1])]
    trees = [_tree([_leaf(r) for r in g]) for g in groups]
    if not trees:
        return []
    root, above = _tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(groups, trees, above):
        for r, path in zip(g, paths):
            path = path + top
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = _leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
            for left, right in path:
                node = _h(left, node, right)
            out.append((r[0], _leaf(r), subroot, root, _h(*[a + b for a, b in path]), node, node == root))
    return sorted(out, key=str)


def _got(docs):
    return sorted(map(tuple, M.manifest(docs, M.without_breaks(F.col("doc_id"), F.col("text"))).collect()), key=str)


def _frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, node string").repartition(parts)


@pytest.mark.parametrize("sizes", [[1], [3], [1, 1], [243, 244, 2], [730, 28, 27, 1], [9, 10] * 13])
def test_whole_result(spark, sizes):
    rows = [(1000 * g + k, f"s{g}", "en", k, f"line\n{k}") for g, n in enumerate(sizes) for k in range(n)]
    assert _got(_frame(spark, rows)) == brute(rows)


def test_several_rounds_of_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 1)
    rows = [(k, f"s{min(k % 11, 1)}", None, None, "a\nb") for k in range(200)]
    assert _got(_frame(spark, rows)) == brute(rows)


def test_odd_rows(spark, docs, rows, no_docs):
    fields = [(r[0], r[3], r[2], r[4], r[1]) for r in rows]
    fields += [(None, "", "", 0, ""), (None, "", "", 0, ""), (5, "=", None, None, "é\n\n"), (-7, None, "x", -1, "\n")]
    assert _got(_frame(spark, fields)) == brute(fields)
    assert M.manifest(no_docs).collect() == []


def test_untampered_table_verifies(spark, docs):
    got = M.manifest(docs).select("verified", "root").distinct().collect()
    assert len(got) == 1 and got[0].verified


def test_repeated_rows_over_ranges(spark):
    rows = [(3, "s", "en", 1, "same")] * 400 + [(2, "s", "en", 1, "other")]
    assert _got(_frame(spark, rows)) == brute(rows)
