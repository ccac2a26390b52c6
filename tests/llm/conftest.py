import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, component_id string"
EN = "the of and thing over house water tree other people".split()
DE = "der die und schön straße über haus wasser baum leute".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "ing", "er", "ung", "en"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and very long texts, repeated rows, near copies and clashing column names."""
    rng = random.Random(5)
    out = []
    for i in range(60):
        words, lang = (EN, "en") if i % 3 else (DE, "de")
        text = prose(rng, words, rng.randint(60, 200))
        if i % 5 == 0:
            text += f' token = "{rng.randrange(16**40):040x}" mail me at jane.doe{i}@mail.example.com or +1 (301) 555-{1000 + i} .'
        out.append((i, text, lang, f"src{i % 4}", len(text)))
    out.append((60, out[3][1], "en", "src1", 1))  # exact copy
    out.append((61, out[4][1] + " tail", "en", "src2", 1))  # near copy
    out.append((62, None, "en", "src0", None))
    out.append((63, "", None, None, 0))
    out.append((63, "", None, None, 0))  # repeated row
    out.append((None, prose(rng, EN, 80), None, None, None))
    out.append((64, prose(rng, EN, 30000), "en", "src0", 1))  # very long
    out.append((65, "12345 !!! 678", "en", "src0", 1))  # no letter
    out.append((66, " \n\t ", "en", "src0", 1))
    out.append((67, 'password = "hunter2hunter2" secret=examplevalue1', "en", "src1", 1))
    out.append((68, out[5][1], None, None, None))
    return [(*r, None, None, "x") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
