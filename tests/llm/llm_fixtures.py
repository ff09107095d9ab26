import random

import pytest

#: Names the operators use inside or return: a caller's table may have them too.
CLASHING = "score double, predicted int, spans string, ids string, key long, label string, n long, row string, t1 long"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty, blank, long, repeated rows and ids, copies, near copies, a shared passage."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tse", "ru", "ön"]) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    base, passage = prose(120), prose(90)
    near = base.split()
    near[7] = "changed"
    copies = [(20 + k, base) for k in range(6)]
    shared = [(30 + k, f"{prose(40)} {passage} {prose(30)}") for k in range(5)]
    long_text = prose(20_000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "Two words"), (None, prose(30)), (None, None), (6, "12 34 56 !?")]
    rows += [(7, prose(60)), (7, prose(50)), (8, prose(80)), (8, None), *copies, (26, " ".join(near)), *shared]
    rows += [(40, long_text), (41, long_text[:-40] + " ending"), (42, "x" * 5000), (43, "ab" * 900 + " tail")]
    rows += [(50, "same row here twice"), (50, "same row here twice"), (None, "no id twice"), (None, "no id twice")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns whose names clash."""
    names = [x.split()[0] for x in CLASHING.split(", ")]
    rows = [(d, t, "en" if k % 3 else None, "src", None, *[None] * len(names)) for k, (d, t) in enumerate(odd_rows)]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
