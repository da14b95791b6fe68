import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string, score string"
WORDS = "der the erth anon ouea tion bleth and of thing ndre hest whan shor in. at, to Érè üß".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) * (r.random() < 0.5) for _ in range(n))


@pytest.fixture(scope="session")
def cases():
    """Rows with nulls in every column, empty and long texts, ties, repeats."""
    base = prose(1, 400)
    near = base.replace(" ", "  ", 3).replace("anon", "anonx", 1)
    rows = [
        (5, base, "en", "b", 10),
        (3, base, "en", "a", 10),
        (7, near, "en", "a", 10),
        (9, prose(2, 50), None, None, None),
        (9, prose(2, 50), None, None, None),
        (9, prose(3, 60), "fr", "a", 5),
        (11, None, "en", "b", 0),
        (12, "", "en", "c", 0),
        (13, " \t\n\x0b", "en", "c", 4),
        (14, "one", "en", "c", 3),
        (15, "one two", "en", "c", 7),
        (None, prose(4, 80), "de", "b", 9),
        (16, prose(5, 20_000), "en", "a", 1),
        (17, "nul\x00 \x1c sep \u0085 word é é <|endoftext|>x \U0001f600", "en", "a", 1),
        *((100 + i, prose(100 + i, 30 + i), "en", "abcd"[i % 4], 1) for i in range(40)),
    ]
    return [(*r, "clash", "clash", "clash") for r in rows]


@pytest.fixture(scope="session")
def docs(spark, cases):
    return spark.createDataFrame(cases, SCHEMA).repartition(3, "n_chars").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
