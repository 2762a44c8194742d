import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, ids int, quality int, best string, `a.b` int"
WORDS = "the of and to in a ing tion over under house Garden river cafe straße éclair один 漢字".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def edge_rows(seed=1, n=40):
    """Texts of every awkward kind, a third of them copies of one, with columns whose names clash."""
    rng = random.Random(seed)
    texts = [None, "", " \t\r\n\x0b\x0c ", "one", "a b c", "x" * 5000, sentence(rng, 3000), "| a | b | c | d | e | f | g | h | i | j"]
    texts += ["\n".join(sentence(rng, rng.randint(4, 30)) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    texts += ["All rights reserved.\n" + sentence(rng, 12), "WOW!! BUY!! NOW!! " * 5, "same line\nsame line\n" + sentence(rng, 20)]
    shared = sentence(rng, 60)
    texts += [shared, shared + " ", shared.replace(" ", "\n")] * 6 + [shared + " Tail."] * 3
    rows = []
    for k, t in enumerate(texts):
        lang = None if k % 7 == 0 else ("en", "fr")[k % 2]
        source = None if k % 11 == 0 else ("hot" if k % 3 else f"s{k % 5}")
        rows.append((k, t, lang, source, len(t or ""), "w", 1, 2, "b", 3))
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    """The awkward table, its (id, text) pairs, and an empty table of the same columns."""
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    return df, [(r[0], r[1]) for r in rows], spark.createDataFrame([], SCHEMA)
