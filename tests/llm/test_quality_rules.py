from tests.llm import brute
from tidemark.llm import quality_rules as q

NAMES = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"


def test_figures_and_verdict(edge):
    df, rows, _ = edge
    judged = q.quality(df)
    assert judged.columns[-1] == "quality_"  # the table has a column "quality" of its own
    found = {r.doc_id: {n: r.quality_[n] for n in NAMES} for r in judged.collect()}
    assert found == {i: brute.quality(t, q.LineRules()) for i, t in rows}
    assert {f["kept"] for f in found.values()} == {True, False}


def test_windows_that_overlap_count_once(spark):
    texts = ["a b c d e f " * 3, "a a a a a a a", "a b c d e x a b c d e", "a b c d e " + "z" * 9 + " a b c d f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.quality.n_repeat_words for r in q.quality(df).collect()}
    assert found == {i: brute.quality(t, q.LineRules())["n_repeat_words"] for i, t in enumerate(texts)}


def test_cleaned_text_keeps_good_lines(spark):
    text = "A good line of prose with words.\nHome | About | News | Contact | Login\nAnother good line here."
    row = q.quality(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.quality.cleaned == "A good line of prose with words.\nAnother good line here."
    assert row.quality.kept


PROSE = "The river rose slowly through the night and by morning the lower fields were under water again. "


def test_lines_by_share_and_by_run(spark):
    menu = "\n".join(["Home", "About us", "News", "Contact", "Shop", "Login now"])
    texts = [
        PROSE + "They mention a privacy policy once, and the story goes on from there with many more words.",
        PROSE + "\nShare this\nSubscribe to our letter\n" + PROSE.upper(),
        menu + "\n" + PROSE + "\n" + PROSE.lower(),
        PROSE + "\nOne.\nTwo words!\nThree more words,\nFour:\nFive (six).\nSeven?",
        PROSE + "\n2024 1 22 333 4444 x\n" + PROSE[::-1],
        menu + "\n" + menu,
        PROSE + "\nHome\nAbout\nNews\nShop\r\n" + PROSE.lower(),
    ]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id int, text string, n_chars int")
    rules = q.LineRules()
    judged = {r.doc_id: r.quality for r in q.quality(df).collect()}
    for i, t in enumerate(texts):
        wanted = brute.quality(t, rules)
        assert {n: judged[i][n] for n in wanted} == wanted
        assert judged[i].cleaned == "\n".join(x for x, bad in brute.line_verdicts(t, rules) if not bad)
    assert judged[0].kept and judged[0].cleaned == texts[0]
    assert "Share" not in judged[1].cleaned and "Subscribe" not in judged[1].cleaned
    assert judged[2].cleaned.startswith("The river") and judged[3].cleaned == texts[3]
    assert "2024" not in judged[4].cleaned and not judged[5].kept and "About" in judged[6].cleaned


def test_stage_passes_cleaned_texts_on(spark):
    text = PROSE + "\nAll rights reserved\n" + PROSE.upper()
    rows = [(1, text, len(text)), (2, PROSE + "\n\n " + PROSE.upper(), 7), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_chars int")
    found = {r.doc_id: (r.text, r.n_chars) for r in q.stage(spark, df, "").collect()}
    clean = PROSE + "\n" + PROSE.upper()
    assert found == {1: (clean, len(clean)), 2: (rows[1][1], 7)}


def test_stage_keeps_columns_and_rows(spark, edge):
    df, rows, empty = edge
    kept = q.stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in rows if brute.quality(t, q.LineRules())["kept"]]
    assert q.stage(spark, empty, "").count() == 0
    assert q.stage(spark, df.union(df), "").count() == 2 * kept.count()
