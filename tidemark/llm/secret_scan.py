"""Secrets in texts: fixed patterns, and Markov models of random strings against ordinary identifiers.

Two kinds of character models (first order, smoothed) are trained from labelled samples. Ordinary
identifiers are words of the corpus that no pattern calls a secret, and names made of two of them; random strings are the values that
the patterns find there and strings drawn with a seed from the alphabets in which keys are written, one
model for each alphabet. A token of at least ``MIN_LENGTH`` characters is a secret if the best random
model beats the ordinary one by more, per character, than the ordinary tokens of the held-out sample
do, and by ``MARGIN`` at least. Spans of the patterns always stay; the models add spans of kind
``random`` that touch none of them.

The sample is bounded: about ``SAMPLE_DOCUMENTS`` documents chosen by a hash of their text, counted on the
executors into matrices of 68 x 68. Every whole text is scanned; nothing shuffles but the counts.

Defined cases: a null text counts as empty; an empty text has no spans; without ordinary words to learn
from, the models add nothing; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, python_ready, quoted, text_of
from tidemark.session import materialize

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
OTHER = len(ALPHABET)
SIZE = OTHER + 1
KEY_ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "urlsafe": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
MIN_LENGTH = 20
MIN_DISTINCT = 8  # characters of a token that must differ
MARGIN = 1.6
SAMPLE_DOCUMENTS = 4000
SYNTHETIC = 400
SEED = 5

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
WORD = re.compile(r"[A-Za-z0-9+/_=-]{3,}")
_PLACE = np.full(256, OTHER, np.int64)
for _k, _c in enumerate(ALPHABET):
    _PLACE[ord(_c)] = _k


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, ascending."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def transitions(token: str) -> np.ndarray:
    """The numbers of the character pairs of a token."""
    c = _PLACE[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]
    return c[:-1] * SIZE + c[1:]


@dataclass
class Models:
    ordinary: np.ndarray | None  # log probabilities of pairs
    random: np.ndarray  # models x pairs
    threshold: float

    def ratio(self, token: str) -> float:
        """The log likelihood ratio per character of the best random model to the ordinary one."""
        pairs = transitions(token)
        random = self.random[:, pairs].sum(axis=1).max()
        return float(random - self.ordinary[pairs].sum()) / max(len(pairs), 1)

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Spans of the patterns, and all spans."""
        base = base_spans(text)
        if self.ordinary is None:
            return base, base
        added = [
            (m.start(), 3, m.end())
            for m in TOKEN.finditer(text)
            if len(set(m.group())) >= MIN_DISTINCT
            and not any(a < m.end() and m.start() < b for a, _, b in base)
            and self.ratio(m.group()) > self.threshold
        ]
        return base, sorted(base + added)


def _logs(counts: np.ndarray, backed: float = 1.0, smoothing: float = 0.1) -> np.ndarray:
    """Log probabilities of the second character of each pair; pairs that were rarely seen fall back on
    the share of that character."""
    table = counts.reshape(SIZE, SIZE)
    share = (table.sum(axis=0) + smoothing) / (table.sum() + smoothing * SIZE)
    return np.log((table + backed * share) / (table.sum(axis=1, keepdims=True) + backed)).ravel()


def identifiers(words: list[str]) -> Iterator[str]:
    """Names as programs write them, from neighbouring words."""
    for a, b in zip(words[::6], words[1::6]):
        a, b = a.lower(), b.lower()
        yield from (f"{a}_{b}", f"{a}-{b}", f"{a}/{b}", a + b.capitalize(), a.capitalize() + b.capitalize(), f"{a}_{b}".upper())


def random_strings(alphabet: str, rng: np.random.Generator, n: int = SYNTHETIC) -> list[str]:
    letters = np.array(list(alphabet))
    return ["".join(rng.choice(letters, size)) for size in rng.integers(MIN_LENGTH, 65, n)]


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair counts of ordinary words (label 0) and found secrets (1), and held-out long ordinary tokens."""
    counts = np.zeros((2, SIZE * SIZE), np.int64)
    held: set[str] = set()
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py() or ""
            base, at = base_spans(text), 0
            for start, _, end in [*base, (len(text), 0, len(text))]:
                words = WORD.findall(text, at, max(at, start))
                for token in [*words, *identifiers(words)]:
                    # Every fourth of the long ordinary tokens is kept back for the threshold.
                    if len(token) >= MIN_LENGTH and sum(map(ord, token)) % 4 == 0:
                        held.add(token)
                        continue
                    np.add.at(counts[0], transitions(token), 1)
                at = max(at, end)
            for start, _, end in base:
                values = WORD.findall(text[start:end])
                if values:
                    np.add.at(counts[1], transitions(max(values, key=len)), 1)
    label, pair = np.nonzero(counts)
    tokens = sorted(held)
    nothing = [None] * len(label)
    yield pa.record_batch(
        [
            pa.array([*label, *[2] * len(tokens)], pa.int32()),
            pa.array([*pair, *[-1] * len(tokens)], pa.int32()),
            pa.array([*counts[label, pair], *[0] * len(tokens)], pa.int64()),
            pa.array(nothing + tokens, pa.string()),
        ],
        names=["label", "pair", "n", "token"],
    )


def fit(df: DataFrame, text: str = "text", seed: int = SEED) -> Models:
    """Train on a bounded sample of documents and seeded random strings."""
    python_ready(df.sparkSession)
    total = df.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(total, 1))
    t = text_of(text)
    chosen = df.select(t.alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    # What documents share is counted once, so that no large group of copies fills the sample.
    chosen = chosen.dropDuplicates(["text"])
    table = chosen.mapInArrow(_sample_counts, "label int, pair int, n bigint, token string")
    table = materialize(table.groupBy("label", "pair", "token").agg(F.sum("n").alias("n")), "secret-sample")
    counts = np.zeros((2, SIZE * SIZE))
    numbers = table.filter("label < 2").toPandas()
    counts[numbers["label"].to_numpy(int), numbers["pair"].to_numpy(int)] = numbers["n"].to_numpy()
    rng = np.random.default_rng(seed)
    models = []
    for alphabet in KEY_ALPHABETS.values():
        own = np.zeros(SIZE * SIZE)
        for token in random_strings(alphabet, rng):
            np.add.at(own, transitions(token), 1)
        models.append(_logs(own))
    if counts[1].sum() >= 10_000:
        models.append(_logs(counts[1]))
    if not counts[0].sum():
        return Models(None, np.array(models), MARGIN)
    found = Models(_logs(counts[0]), np.array(models), MARGIN)
    highest = table.filter("label = 2").select("token").mapInArrow(_highest(found), "ratio double")
    highest = highest.agg(F.max("ratio")).first()[0]
    return Models(found.ordinary, found.random, MARGIN if highest is None else max(MARGIN, highest + 0.2))


def _highest(models: Models):
    """A mapInArrow function: the highest ratio of the held-out tokens of a task that look ordinary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = (models.ratio(token) for batch in batches for token in batch.column(0).to_pylist())
        most = max((r for r in ratios if r < MARGIN + 0.4), default=None)
        yield pa.record_batch([pa.array([most], pa.float64())], names=["ratio"])

    return run


def scanned(text: Column, models: Models) -> Column:
    """A struct of the number of spans by pattern and both span lists as strings."""

    @F.arrow_udf("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,n_random:bigint,base:string,spans:string>")
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            base, spans = models.spans(t.as_py() or "")
            numbers = [0] * len(KINDS)
            for _, kind, _ in spans:
                numbers[kind] += 1
            rows.append((*numbers, written(base), written(spans)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(arrays, names=["n_assign", "n_access", "n_hex", "n_random", "base", "spans"])

    return scan(text)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def op7_secret_scan(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    models = fit(docs)
    rows = docs.select("doc_id", scanned(text_of("text"), models).alias("s"))
    return rows.select(
        quoted("doc_id"),
        *(F.col(f"s.{n}") for n in ("n_assign", "n_access", "n_hex", "n_random")),
        F.sha2("s.base", 256).alias("base_sha256"),
        F.col("s.spans").alias("spans"),
    )
