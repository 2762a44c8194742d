"""Line-first quality rules in SQL functions alone.

Every line with a word is judged by punctuation, navigation and boilerplate rules; failing lines are
removed, and a document that loses too much of its text is rejected. Base figures of the whole
document (words, symbols, repeated lines, repeated five-word windows) reject it before that. Documents that
stay are passed on without their failing lines; a text that loses none stays as it is.

Lines fail by themselves (symbols, exclamation marks, separators, few letters, boilerplate phrases that make up
a share of them) or as part of a run of short lines without an end punctuation, as menus are.

Defined cases: a null text counts as empty; an empty text has no words and fails; rows are judged one
by one, so ties and repeated rows get equal results; an empty table gives an empty table; columns of
the input are never read by name apart from the two given ones, so clashing names do no harm.

Everything is computed within a row: there is no shuffle, and the work of a text of n words is
O(n), or O(n log n) where windows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, columns, documents, fresh, quoted, text_of, words_of

SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; shares are whole percentages so that no rounding decides."""

    symbol_percent: int = 10  # symbols among the characters of the words of a line
    shout_percent: int = 30  # "!!" against the number of words
    bar_count: int = 3  # separators of a navigation line at least
    bar_percent: int = 12  # separators against the number of words
    letter_percent: int = 25  # letters among the characters of the words of a line at least
    menu_words: int = 3  # words of a short line at most
    menu_lines: int = 5  # short lines without an end punctuation one after another that make a menu
    lost_percent: int = 50  # of the word characters; a document that loses more is rejected
    phrase_percent: int = 30  # characters of phrases among those of the words of a line
    phrases: tuple[str, ...] = (
        "accept cookies",
        "all rights reserved",
        "click here",
        "cookie policy",
        "enable javascript",
        "lorem ipsum",
        "privacy policy",
        "share this",
        "skip to content",
        "sign up for our newsletter",
        "subscribe to our",
        "terms of service",
        "terms of use",
    )

    def short_line(self) -> str:
        """A pattern of lines of few words."""
        more = f"{{0,{self.menu_words - 1}}}"
        return rf"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+([\x20\x09-\x0D]+[^\x20\x09-\x0D]+){more}[\x20\x09-\x0D]*\z"


# A line of less than half letters starts with another character or has two others side by side. Letters
# beyond ASCII count as others here, so that the test is quick and only lets more lines through.
MAYBE_FEW_LETTERS = r"(?:^|[^A-Za-z\x20\x09-\x0D])[\x20\x09-\x0D]*[^A-Za-z\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A mark that ends a sentence or a part of one, with quotes or brackets behind it.
ENDED = r"""[.!?:;,…。！？]["'”’»)\]]*[\x20\x09-\x0D]*\z"""


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _has_phrase(text: Column, rules: LineRules) -> Column:
    found = F.lit(False)
    for p in rules.phrases:
        found = found | F.contains(F.lower(text), F.lit(p))
    return found


def _line_fails(line: Column, rules: LineRules, phrases: Column) -> Column:
    """``phrases`` tells whether the text may have a phrase at all; most have none, and their lines are not searched."""
    n_chars = _length_without(line, BLANK + "+")
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    symbols = _length_without(line, SYMBOLS)
    shouts = F.regexp_count(line, F.lit("!!+"))
    bars = F.regexp_count(line, F.lit(r"[|»•·]"))
    odd = line.rlike(r"[#*$%&|<>»•·]|!!")
    others = _length_without(line, r"[\p{L}\x20\x09-\x0D]+")
    without = _length_without(F.translate(line, UPPER, LOWER), "|".join([*rules.phrases, BLANK + "+"]))
    return (
        (phrases & ((n_chars - without) * 100 >= n_chars * rules.phrase_percent))
        | (line.rlike(MAYBE_FEW_LETTERS) & ((n_chars - others) * 100 < n_chars * rules.letter_percent))
        | (
            odd
            & (
                (symbols * 100 >= n_chars * rules.symbol_percent)
                | (shouts * 100 >= n_words * rules.shout_percent)
                | ((bars >= rules.bar_count) & (bars * 100 >= n_words * rules.bar_percent))
            )
        )
    )


def _line_kinds(lines: Column, rules: LineRules) -> Column:
    """A character per line: s for short ones without an end punctuation, p for others."""
    kind = lambda x: F.when(x.rlike(rules.short_line()) & ~x.rlike(ENDED), "s").otherwise("p")
    return F.array_join(F.transform(lines, kind), "")


def _menu_lines(kinds: Column, rules: LineRules) -> Column:
    """Per line, whether it is part of a run of short lines; empty if there is no such run."""
    runs = F.transform(
        F.regexp_extract_all(kinds, F.lit("s+|p"), F.lit(0)),
        lambda r: F.array_repeat(F.startswith(r, F.lit("s")) & (F.length(r) >= rules.menu_lines), F.length(r)),
    )
    none = F.array().cast("array<boolean>")
    return F.when(F.contains(kinds, F.lit("s" * rules.menu_lines)), F.flatten(runs)).otherwise(none)


def _repeated_positions(df: DataFrame, windows: str, out: str) -> DataFrame:
    """Ascending positions of the windows whose hash occurs twice or more in ``windows``.

    Hashes have 64 bits; sorting them with their positions puts equal ones side by side. A text
    whose hashes are all distinct skips the sort.
    """
    (sorted_,) = fresh(df, "sorted_windows")
    numbered = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    distinct = F.size(F.array_distinct(windows)) == F.size(windows)
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn(sorted_, F.when(distinct, empty).otherwise(F.sort_array(numbered)))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    marked = F.transform(
        sorted_,
        lambda s, k: F.when(same(s, F.get(F.col(sorted_), k - 1)) | same(s, F.get(F.col(sorted_), k + 1)), s["i"]),
    )
    return df.withColumn(out, F.sort_array(F.array_compact(marked))).drop(sorted_)


def quality(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``df`` with a struct column ``quality`` behind them (or ``quality_`` and so on if
    there is one): base figures, the share lost, the cleaned text and the verdict ``kept``."""
    own = df.columns
    t, words, lines, phrases, kinds, menu, windows, positions, good, result = fresh(
        df, "t", "words", "lines", "phrases", "kinds", "menu", "windows", "positions", "good_lines", "quality"
    )
    df = df.withColumn(t, text_of(text)).withColumn(phrases, _has_phrase(F.col(t), rules))
    df = df.withColumn(words, words_of(F.col(t))).withColumn(
        lines, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    w = F.col(words)
    df = df.withColumn(
        windows,
        F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))),
        ),
    )
    df = _repeated_positions(df, windows, positions)
    p = F.col(positions)
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - x), F.lit(WINDOW))),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    df = df.withColumn(kinds, _line_kinds(F.col(lines), rules)).withColumn(menu, _menu_lines(F.col(kinds), rules))
    listed = F.col(menu)
    df = df.withColumn(
        good,
        F.filter(
            lines, lambda x, i: ~F.coalesce(F.get(listed, i), F.lit(False)) & ~_line_fails(x, rules, F.col(phrases))
        ),
    )
    joined = F.array_join
    chars = F.length(joined(w, ""))
    all_good = F.size(good) == F.size(lines)
    base = {
        "n_words": F.size(w),
        "word_chars": chars,
        "n_symbols": _length_without(F.col(t), SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "left_chars": F.when(all_good, chars).otherwise(_length_without(joined(good, ""), BLANK + "+")),
    }
    figures = [c.cast("bigint").alias(n) for n, c in base.items()]
    df = df.withColumn(result, F.struct(*figures, joined(good, "\n").alias("cleaned")))
    q = F.col(result)
    failed = (q["n_words"] < 10) | (q["n_repeat_words"] * 100 > q["n_words"] * 20)
    lost = (q["word_chars"] - q["left_chars"]) * 100 > q["word_chars"] * rules.lost_percent
    whole = q.withField("base_failed", failed).withField("kept", ~failed & ~lost)
    return df.select(*columns(own), whole.alias(result))


def kept_rows(
    df: DataFrame, text: str = "text", rules: LineRules = LineRules(), n_chars: str | None = None
) -> DataFrame:
    """Only the rows that pass, without the lines that fail; ``n_chars`` names a column of the number of code
    points, set anew where lines went."""
    judged = quality(df, text, rules)
    # The optimiser would push the filter below the steps that keep intermediate arrays, and so compute
    # them again for each element; it does not do so across a column of row numbers.
    (row,) = fresh(judged, "row")
    found = quoted(judged.columns[-1])
    verdict = found["kept"] & (F.col(row) >= 0)
    numbered = judged.withColumn(row, F.monotonically_increasing_id())
    whole = found["left_chars"] == found["word_chars"]
    now = {text: F.when(whole, quoted(text)).otherwise(found["cleaned"])}
    if n_chars is not None:
        now[n_chars] = F.when(whole, quoted(n_chars)).otherwise(F.length(found["cleaned"]).cast(df.schema[n_chars].dataType))
    return numbered.filter(verdict).select(*[now.get(c, quoted(c)).alias(c) for c in df.columns])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def op2_quality_rules(spark, folder: str) -> DataFrame:
    judged = quality(documents(spark, folder).select("doc_id", "text"))
    names = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    return judged.select("doc_id", *(F.col(f"quality.{n}") for n in names))


def _sql(rules: LineRules = LineRules()) -> str:
    phrases = "|".join([*rules.phrases, BLANK + "+"])
    ended = ENDED.replace("'", "''")
    letters = r"[\p{L}\x20\x09-\x0D]+"
    chars = r"length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
k AS (
  SELECT *, regexp_extract_all(array_to_string(list_transform(ls, lambda l: CASE
    WHEN regexp_matches(l, '{rules.short_line()}') AND NOT regexp_matches(l, '{ended}') THEN 's' ELSE 'p' END), ''), 's+|p') AS runs
  FROM l),
w AS (
  SELECT *, flatten(list_transform(runs, lambda r: list_transform(range(length(r)),
    lambda j: starts_with(r, 's') AND length(r) >= {rules.menu_lines}))) AS menu FROM k),
g AS (
  SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (
  SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
f AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    list_filter(ls, lambda l, i: NOT (menu[i]
      OR ({chars} - length(regexp_replace(translate(l, '{UPPER}', '{LOWER}'), '{phrases}', '', 'g'))) * 100 >= {rules.phrase_percent} * {chars}
      OR ({chars} - length(regexp_replace(l, '{letters}', '', 'g'))) * 100 < {rules.letter_percent} * {chars}
      OR length(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) * 100 >= {rules.symbol_percent} * length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))
      OR len(regexp_extract_all(l, '!!+')) * 100 >= {rules.shout_percent} * len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))
      OR (len(regexp_extract_all(l, '[|»•·]')) >= {rules.bar_count}
        AND len(regexp_extract_all(l, '[|»•·]')) * 100 >= {rules.bar_percent} * len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))))) AS good
  FROM w LEFT JOIN c USING (doc_id)),
v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    length(regexp_replace(array_to_string(good, ''), '[\x20\x09-\x0D]+', '', 'g')) AS left_chars FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars - left_chars) * 100 > {rules.lost_percent} * word_chars AS kept
FROM v"""


SQL = _sql()
