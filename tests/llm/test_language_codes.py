import random

import numpy as np
import pytest

from tidemark.llm import language_codes as g

WORDS = {
    "en": "the of and to in is that it was for on are with as his they at be this from have or by",
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es",
    "es": "el la de que y a en un ser se no haber por con su para como estar tener le lo todo pero más",
}


def rows(n, seed, languages=tuple(WORDS)):
    rng = random.Random(seed)
    return [
        (k, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(8, 40))), lang)
        for k, lang in enumerate(languages * n)
    ]


@pytest.fixture(scope="module")
def model(spark):
    return g.fit(spark.createDataFrame(rows(40, 1), "doc_id bigint, text string, lang string"))


def test_held_out_accuracy(model):
    found = [model.predict(text)[0] == lang for _, text, lang in rows(50, 2)]
    assert np.mean(found) > 0.97


def test_codewords_differ():
    for n in (2, 3, 4, 6, 7, 20, 60):
        codes = g.codewords(n)
        apart = [(codes[i] != codes[j]).sum() for i in range(n) for j in range(i)]
        assert len(codes) == n and min(apart) >= (2 ** (n - 2) if n <= 6 else 5)
        assert (np.abs(codes.sum(axis=0)) < n).all()


def test_one_wrong_bit_is_corrected(model):
    text = rows(1, 9)[0][1]
    margins = model.margins(text)
    for bit in range(len(margins)):
        broken = margins.copy()
        broken[bit] *= -0.3
        loss = np.logaddexp(0, -model.codes * broken) @ model.trust
        assert model.languages[int(loss.argmin())] == "en"


def test_unclear_texts_are_flagged(model):
    for text in (None, "", "  ", "123 !!", "²½"):
        assert model.predict(text) == ("und", 0.0, True)
    lang, score, unclear = model.predict("en")
    assert lang in WORDS and 0 < score <= 1
    assert not model.predict(rows(1, 5)[0][1])[2]


def test_few_languages_and_null_labels(spark, edge):
    df, pairs, empty = edge
    assert g.fit(empty).predict("text") == ("und", 0.0, True)
    one = spark.createDataFrame([(1, "some text", "xx"), (2, "more", None), (3, None, "yy")], "doc_id int, text string, lang string")
    assert g.fit(one).predict("anything") == ("xx", 1.0, False)
    model = g.fit(df)
    assert model.languages == ["en", "fr"]
    found = df.select("doc_id", g.predicted(g.F.col("text"), model).alias("p")).collect()
    assert len(found) == len(pairs) and all(0 <= r.p.score <= 1 for r in found)
    assert empty.select(g.predicted(g.F.col("text"), model)).count() == 0
