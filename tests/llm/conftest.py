import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, doc long, shard_ string, node long"


@pytest.fixture(scope="session")
def words():
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls, empty and blank texts, a long one, exact and near copies, a repeated row, odd letters; ids in no order."""
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    passage = words(60, 2)
    texts = [
        (7, base), (3, base), (12, " ".join(near)), (1, None), (2, ""), (4, " \n\t "), (5, "a b  c"), (6, "a\tb c"),
        (8, words(40, 3) + "\n" + passage + "\n" + words(40, 4)), (9, words(30, 5) + " " + passage), (10, passage + " " + words(35, 6)),
        (11, words(3000, 7)), (13, "x" * 5000), (14, "Straße ŒUVRE été ñandú 漢字 <|endoftext|> it's 12 ΑΣ İ é"), (15, base), (15, base),
        (16, "one\ntwo\n\nthree\r\n\r\nfour"), (17, "ab" * 150),
    ]
    return [(i, t, None if i % 3 else "en", None, len(t or ""), 1, "s", 2) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DDL)
