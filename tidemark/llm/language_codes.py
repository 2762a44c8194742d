"""Language identification by error-correcting output codes.

Each language has a codeword of plus and minus ones. For each bit a binary classifier of byte n-grams
tells the languages with a plus from those with a minus: its weights are the log ratios of smoothed
n-gram shares, from counts over all training rows (added up on Spark; the table of languages times
``2 ** HASH_BITS`` features is all that reaches the driver). A text is decoded to the codeword with the
least logistic loss over the bits, each bit weighted by its accuracy on training rows; a small lead over
the second codeword marks the answer as ambiguous.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text when no
row can be learned from; one single language is predicted with score 1; rows with a null language are
not learned from; repeated rows count as often as they come; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, python_ready, quoted
from tidemark.session import materialize

HASH_BITS = 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
AMBIGUOUS = 0.8
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SPREAD = np.uint32(2654435761)


def ngram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of the lower-cased UTF-8 bytes occurs."""
    data = np.frombuffer(b" " + text.lower().encode(errors="replace") + b" ", np.uint8).astype(np.uint32)
    total = np.zeros(1 << HASH_BITS, np.int64)
    for n in ORDERS:
        if len(data) < n:
            continue
        value = np.full(len(data) - n + 1, n, np.uint32)
        for k in range(n):
            value = value * np.uint32(257) + data[k : len(data) - n + 1 + k]
        total += np.bincount((value * _SPREAD) >> np.uint32(32 - HASH_BITS), minlength=len(total))
    return total


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """One row of plus and minus ones for each of ``n`` languages: all splits of up to six, beyond that
    random words, each the farthest from those before it out of 64."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, float).T
    draw = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(n)))
    words = [draw.choice([-1.0, 1.0], length)]
    while len(words) < n:
        tries = draw.choice([-1.0, 1.0], (64, length))
        apart = length - np.abs(tries @ np.array(words).T).max(axis=1)
        words.append(tries[int(apart.argmax())])
    found = np.array(words)
    return found[:, np.abs(found.sum(axis=0)) < n]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    trust: np.ndarray  # bits

    def margins(self, text: str) -> np.ndarray:
        counts = ngram_counts(text)
        return np.clip(counts @ self.weights / np.sqrt(max(counts.sum(), 1)), -6, 6)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether a second language is nearly as likely."""
        if not self.languages or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = np.logaddexp(0, -self.codes * self.margins(text)) @ self.trust
        order = np.argsort(loss, kind="stable")
        likely = np.exp(loss[order[0]] - loss)
        score = float(likely[order[0]] / likely.sum())
        return self.languages[order[0]], score, score < AMBIGUOUS


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            counts = ngram_counts(text.as_py() or "")
            lang = lang.as_py()
            totals[lang] = totals[lang] + counts if lang in totals else counts
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])],
            names=["lang", "feature", "n"],
        )


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows that have a language and a letter."""
    python_ready(rows.sparkSession)
    rows = rows.select(quoted(text).alias("text"), quoted(lang).cast("string").alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(_count_ngrams, "lang string, feature int, n bigint")
    table = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = materialize(table, "language-counts").toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), 1 << HASH_BITS))
    place = {name: k for k, name in enumerate(languages)}
    counts[table["lang"].map(place).to_numpy(int), table["feature"].to_numpy(int)] = table["n"].to_numpy()
    codes = codewords(len(languages))
    # Each language weighs the same, whatever its number of rows.
    share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True) if languages else counts
    weights = np.zeros((1 << HASH_BITS, codes.shape[1]), np.float64)
    for bit in range(codes.shape[1] if len(languages) > 1 else 0):
        plus, minus = share[codes[:, bit] > 0].mean(axis=0), share[codes[:, bit] < 0].mean(axis=0)
        weights[:, bit] = np.log(plus / minus)
    # How far the mean n-gram of a language lies on its right side tells how far a bit can be trusted.
    trust = np.ones(codes.shape[1])
    if len(languages) > 1:
        right = ((share @ weights) * codes).min(axis=0)
        trust = np.maximum(right, 1e-3)
        trust = trust / trust.mean()
    return Model(languages, codes, weights.astype(np.float32), trust)


def predicted(text: Column, model: Model) -> Column:
    """A struct of language, score and ambiguity for a text column."""

    @F.arrow_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        kinds = pa.string(), pa.float64(), pa.bool_()
        values = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(values, names=["lang", "score", "ambiguous"])

    return predict(text)


def op10_language_codes(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    held_out = F.coalesce(held_out, F.lit(False))
    model = fit(docs.filter(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), predicted(F.col("text"), model).alias("p"))
    return rows.select(
        "doc_id",
        "held_out",
        F.col("p.lang").alias("lang_pred"),
        F.col("p.score").alias("score"),
        F.col("p.ambiguous").alias("ambiguous"),
    )
