from __future__ import annotations

import random

import pytest

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many".split()
BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def prose(r: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = r.choice(WORDS)
        out.append(w + (". " if i % 9 == 8 else " "))
    return "".join(out).strip()


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, near copies, and repeated rows."""
    r = random.Random(11)
    rows = [(i, prose(r, r.randint(1, 120)), r.choice(["en", "xx"])) for i in range(60)]
    rows += [(100 + i, rows[3][1].replace(" ", "  "), "en") for i in range(12)]
    rows += [(200, None, None), (201, "", "en"), (202, " \n\t", "en"), (None, "no id here", "en"), (None, rows[5][1], "en"), (7, rows[7][1], "en")]
    rows += [(300, prose(r, 6000), "en"), (301, "word", "en"), (302, "émigré Ünïcode " * 3, "xx")]
    return rows


@pytest.fixture
def docs(spark, corpus):
    """The corpus with extra columns whose names the operators use themselves."""
    rows = [(*row, f"k{i}", i, "s", None) for i, row in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row_key string, component_id int, size string, salt string")


@pytest.fixture
def none(docs):
    return docs.limit(0)
