import time

import random

from conftest_llm import prose as numbered

from gridlark.llm import line_dedup


def prose(rng, n, vocabulary):
    """Words without digits, which would be variable fields."""
    return numbered(rng, n, vocabulary).translate({48 + k: 97 + k for k in range(10)})


SCHEMA = "doc_id long, text string, row string"


def deduped(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    got = line_dedup.deduped(df, **more).selectExpr("row.doc_id", "clean_text", "n_lines", "n_dropped").collect()
    return {r.doc_id: r for r in got}


def test_recurring_lines_stay_once(spark):
    rng = random.Random(1)
    own = {k: prose(rng, 30, 9000) for k in range(40)}
    text = {k: f"{own[k]}\nPage {k} of 99 in the printed report\n\nthe very same footer line" for k in own}
    got = deduped(spark, [*text.items(), (100, None), (101, ""), (102, " \n\t")])
    assert got[0].clean_text == text[0] and got[0].n_dropped == 0
    assert all(got[k].clean_text == own[k] + "\n" and got[k].n_dropped == 2 for k in range(1, 40))
    assert (got[100].clean_text, got[100].n_lines, got[101].clean_text, got[102].n_lines) == (None, 0, "", 0)


def test_varying_words_are_opened(spark):
    rng = random.Random(2)
    line = lambda w: f"the visitor book was signed by {w} in our little town hall"
    rows = [(k, line("name" + "".join(rng.choices("abcdefgh", k=9))) + "\n" + prose(rng, 20, 9000)) for k in range(30)]
    got = deduped(spark, rows)
    assert sum(r.n_dropped for r in got.values()) == 29 and got[0].n_dropped == 0


def test_rare_and_repeated_rows(spark):
    rows = [(k, "a line of nine documents only, as it is\nown words here: " + chr(97 + k) * 3) for k in range(9)]
    rows += [rows[0]] * 20
    got = deduped(spark, rows)
    assert not any(r.n_dropped for r in got.values())
    assert deduped(spark, []) == {}


def test_stage_keeps_columns_and_rows(docs, rows):
    got = line_dedup.stage(docs)
    assert got.columns == docs.columns and got.count() == len(rows)


def test_stage_drops_long_lines_from_two_documents_on(spark):
    rng = random.Random(4)
    passage, nine, short = prose(rng, 60, 9000), prose(rng, 51, 9000), prose(rng, 50, 9000)
    own = {k: prose(rng, 20, 9000) for k in range(20)}
    text = {k: "\n".join([own[k], *[passage] * (k in (3, 7)), *[nine] * (k < 9), *[short] * (10 < k < 20)]) for k in own}
    got = {r.doc_id: r.text for r in line_dedup.stage(spark.createDataFrame([(k, t, "x") for k, t in text.items()], SCHEMA).repartition(4)).collect()}
    want = {k: "\n".join([own[k], *[passage] * (k == 3), *[nine] * (k == 0), *[short] * (10 < k < 20)]) for k in own}
    assert got == want


def test_templates_are_counted_in_documents(spark):
    rng = random.Random(5)
    name = lambda: "name" + "".join(rng.choices("abcdefgh", k=9))
    line = lambda w: f"the visitor book was signed by {w} in our little town hall"
    log = "\n".join(line(name()) for _ in range(30))
    got = deduped(spark, [(0, log), *[(k, line(name())) for k in range(1, 9)]])
    assert not any(r.n_dropped for r in got.values())
    got = deduped(spark, [(0, log), *[(k, line(name())) for k in range(1, 10)]])
    assert got[0].n_dropped == 29 and all(got[k].n_dropped == 1 for k in range(1, 10))


def test_lines_of_numbers_are_left_alone(spark):
    rows = [(k, f"{k} {k * k} {k + 7}\n2024-01-{k:02} total {k}\nown words " + chr(97 + k) * 3) for k in range(1, 15)]
    assert not any(r.n_dropped for r in deduped(spark, rows).values())


def test_very_long_lines_and_no_doc_id(spark):
    """Time is linear in a line's words and a text's lines; a row without doc_id is never the first."""
    long = " ".join(f"w{k}" for k in "abcdefghij" * 3000)
    many = "\n".join(["one and the same short line of every text"] * 20_000)
    rows = [(k if k else None, f"{long}\n{many}\nown words {chr(97 + k)}") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    got = {r["row"]["doc_id"]: r for r in line_dedup.deduped(df).collect()}
    assert time.time() - start < 60
    assert got[1].n_dropped == 19_999 and got[1].clean_text.startswith(long)
    assert all(r.n_dropped == 20_001 and r.clean_text.startswith("own words") for k, r in got.items() if k != 1)
