import random

import pytest

WORDS = "the of and ron tal mes kor vin sal pra dun lek wob hin zet".split()


def made(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.choice("abcdefgh")) * r.randint(0, 2) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """(doc_id, text) with nulls, empties, very long texts, copies, near copies and shared passages."""
    long = made(60_000, 1)
    passage = made(60, 2)
    rows = [(10, None), (11, ""), (12, "   \n\t "), (13, "one"), (14, "One"), (15, "two words"), (16, long), (3, long[: len(long) // 2])]
    rows += [(20 + i, made(80, 100 + i)) for i in range(10)]
    rows += [(40 + i, made(80, 100)) for i in range(5)]
    rows += [(50 + i, made(80, 100 + i).replace("the", "xyz", 1)) for i in range(5)]
    rows += [(60 + i, made(30, 200 + i) + "\n" + passage + "  " + made(30, 300 + i)) for i in range(5)]
    rows += [(70, "a a a a a a a a a a a a a a a a a a a a a a a a"), (71, "naïve ÉTÉ 日本語   x\x1cy\x0bz"), (20, made(80, 100))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with further columns whose names operators use themselves."""
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", 1, 2.0, 3) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash string, rank int, score double, component_id int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
