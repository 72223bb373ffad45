import random

import pytest
from conftest_llm import prose


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars, row): copies, near copies, nulls, empty and long texts, ties."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(30, 200)) + "\n" + prose(rng, 20) for _ in range(60)]
    texts += [texts[3]] * 12 + [texts[4] + " one more"] * 3
    for k in range(10):
        w = texts[5].split(" ")
        w[7 * k % len(w)] = f"changed{k}"
        texts.append(" ".join(w))
    texts += [None, "", "   \n\t ", "solo", "two words", "solo", "A B c", "a b C", "x" * 50_000, prose(rng, 30_000)]
    texts += [f"page {k} of 99 in the printed report of this year\n" + prose(rng, 40) for k in range(15)]
    texts += [prose(rng, 12) + "\nAll rights reserved.\n" + prose(rng, 40) for _ in range(15)]
    texts += ["é ü 漢字   tail  more\x1c words", "a\x0bb\x0cc\rd", "++ ## ** $$ %% && || << >>"]
    out = []
    for k, t in enumerate(texts):
        source = [None, "src1", "src0", "src2", "ß", "src0"][k % 6]
        out.append((k, t, "en", source, len(t or ""), f"extra{k}"))
    out.append(out[2])
    out.append((None, texts[3], None, None, None, None))
    out.append((None, None, None, None, None, None))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
