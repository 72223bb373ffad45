import re

from conftest_llm import tokens

from gridlark.llm import quality_rules


def brute(text):
    text = text or ""
    found = tokens(text)
    lines = [x for x in text.split("\n") if tokens(x)]
    grams = [tuple(found[k : k + 5]) for k in range(len(found) - 4)]
    where = {}
    for k, g in enumerate(grams):
        where.setdefault(g, []).append(k)
    repeat = {k + j for at in where.values() if len(at) > 1 for k in at for j in range(5)}
    failed = len(found) < 10 or 100 * len(repeat) > 20 * len(found)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed


def test_base_matches_brute_force(docs, rows):
    got = quality_rules.judged(docs).select("row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:7] == brute(r.text)
        assert not (r.kept and r.base_failed)


def test_lines_and_verdicts(spark):
    clean = "this is a plain line of words, as a person would write it down"
    bad = ["home | about | news | contact", "all rights reserved by us", "### $$$ %%% *** <<< >>>"]
    rows = [(1, "\n".join([clean] + bad[:1] + [clean[::-1]])), (2, "\n".join([*bad, "a b c d", "home | a | b | c | d", *bad])), (3, clean), (4, None), (5, "")]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "clean_text", "kept").collect()}
    assert got[1].kept and got[1].clean_text == clean + "\n" + clean[::-1]
    assert got[3].kept and got[3].clean_text == clean
    assert not got[2].kept and not got[4].kept and not got[5].kept


def test_stage(docs, no_docs):
    assert quality_rules.stage(docs).columns == docs.columns
    assert quality_rules.stage(no_docs).collect() == []
