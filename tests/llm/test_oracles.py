"""The queries that SQL can express against their DuckDB twins, over whole tables."""

import os
import random

import duckdb
import pytest

from gridlark.llm.oracles import ORACLE_SQL
from gridlark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ORACLE_SQL)
def test_matches_duckdb(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=str)
    assert len(got) == len(want)
    assert [x for x in zip(got, want) if x[0] != x[1]][:2] == []


def _odd_lines():
    """Documents on which other rules of counting lines would differ."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    signed = lambda: f"the visitor book was signed by {letters(9)} in our little town hall"
    long, longer = " ".join(letters(5) for _ in range(60)), " ".join(letters(5) for _ in range(51))
    texts = [f"{k} {k + 1} {k * k}\n{letters(12)} {letters(7)}" for k in range(12)]  # a line of numbers in each
    texts.append("\n".join(signed() for _ in range(12)))  # one document holds a template twelve times
    texts += [signed() + "\n" + letters(30) for _ in range(4)]
    texts += [f"{letters(8)}\n{long}" for _ in range(2)] + [f"{longer}\n{letters(8)}" for _ in range(9)]
    texts += [f"part {k} of the list is here\n" + "a line of nine documents only" * (k < 9) for k in range(12)]
    texts += [f"the new shop {letters(6)} in {letters(5)} street opens at noon on friday" for _ in range(11)]
    texts += [long.replace(" ", " 7 ", 1), "", None]
    return [(k, t) for k, t in enumerate(texts)]


def test_line_dedup_counts_as_its_twin(spark, tmp_path):
    rows = _odd_lines()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: tuple(r[1:]) for r in con.execute(f"SELECT doc_id, text, n_lines, n_dropped FROM ({ORACLE_SQL['op3_line_dedup']})").fetchall()}
    known = {k: v for k, v in want.items() if dict(rows)[k] is not None}
    assert {k: got[k] for k in known} == known
    dropped = [got[k][2] for k in range(len(rows))]
    assert sum(dropped[:17]) == 0  # numbers stay, and so does what few documents hold
    assert sum(dropped[17:19]) == 1 and sum(dropped[19:28]) == 8  # long lines recur from two documents on
    assert sum(dropped[28:40]) == 11 and sum(dropped[40:51]) == 10
