import random

import pytest

WORDS = "the of and in water light stone river green letter number paper market garden window music silver winter summer bridge".split()


@pytest.fixture(scope="session")
def prose():
    """A maker of random sentences."""

    def make(r: random.Random, n: int) -> str:
        return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "er", str(r.randint(0, 9))]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark, prose):
    """Documents with nulls, empties, copies, shared passages, repeated rows, one long text and clashing extra columns."""
    r = random.Random(7)
    passage = prose(r, 30)
    rows = []
    for i in range(60):
        t = prose(r, r.randint(1, 120))
        if i % 7 == 0:
            t = t + ". " + passage + " " + prose(r, 10)
        if i % 11 == 5:
            t = rows[i - 3][1]
        rows.append((i, t, f"src{i % 3}", 1, "x"))
    base = prose(r, 200).split()
    for i in range(60, 70):  # near copies
        w = list(base)
        w[i * 2] = "changed"
        rows.append((i, " ".join(w), "src0", 1, "x"))
    rows += [(70, None, "src0", None, None), (71, "", None, None, None), (None, passage, "src1", 1, "x"), (72, "a" * 5000, "src2", 1, "x"), (73, prose(r, 20_000), "src2", 1, "x"), (74, " \n\t ", "src1", 1, "x"), (75, "é漢😀 " * 40, "src1", 1, "x")]
    rows += [rows[3], rows[3], (5, "another text under a known id " * 5, "src1", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, node long, row string").repartition(3).cache()
