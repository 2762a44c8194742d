"""Personal data: fixed patterns, and boosted trees over the spans of high-recall generators.

Generators propose overlapping candidate spans in four kinds, wider than the patterns: addresses written
with "(at)" and "dot", dotted quads with brackets, digit groups of 13 to 19 digits, phone numbers without
a plus. Boosted trees (logistic loss, depth 3, histogram splits, in numpy) score each candidate from its
format (digits, marks, group sizes, Luhn) and its context (words before it, characters around it).

The trees learn from a labelled sample: candidates of about ``SAMPLE_DOCUMENTS`` documents, labelled by the
patterns or, as negative, by a format that excludes personal data, and seeded examples of both classes in context. Scores are calibrated by a logistic fit on a
held-out part, and a kind's threshold is the lowest probability at which held-out precision reaches
``PRECISION``. Spans of the patterns always stay; accepted candidates are added, best first, where they
touch no span yet. Every whole text is scanned, and nothing shuffles but the sample.

Defined cases: a null text counts as empty; an empty text has no spans; an empty table trains on the
seeded examples alone and gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, python_ready, quoted, text_of

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCUMENTS = 4000
SAMPLE_CANDIDATES = 20_000
SYNTHETIC = 400
PRECISION = 0.99
SEED = 3

# --- the patterns -----------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: a match takes all local characters before an @, so each @ is tried once."""
    before, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > before and text[start - 1] in _LOCAL:
            start -= 1
        # Where the local part of a failing @ ends, the next one begins behind that @ in any case.
        match = DOMAIN.match(text, at + 1) if start < at else None
        before = match.end() if match else at + 1
        if match:
            yield start, match.end()
        at = text.find("@", before)


def _octets(text: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in text.split(".")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    found = [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if _octets(m.group())]
        for m in CARD.finditer(text):
            digits = digits_of(m.group()) if m.end() - m.start() >= 16 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return found


# --- candidates -------------------------------------------------------------------------------------

_AT = r"(?:\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?|\x20at\x20)"
_DOT = r"(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20)"
GENERATORS = (
    re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}", re.I | re.A),
    re.compile(r"(?<![0-9.])[0-9]{1,4}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,4}){3}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){12,18}(?![0-9])"),
    re.compile(r"(?<![0-9+])\+?\(?[0-9]{1,4}\)?(?:[\x20./-]{0,2}\(?[0-9]{2,4}\)?){1,5}(?![0-9])"),
)
_HINT = re.compile(r"[0-9@]|[([{]at[)\]}]|\x20at\x20", re.I)
CONTEXT = {
    "mail": ("mail", "contact", "write to", "reach"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "dial"),
    "card": ("card", "visa", "credit", "payment", "iban", "account"),
    "ip": ("ip", "address", "host", "server", "client"),
    "other": ("order", "version", "isbn", "invoice", "total", "price", "page", "date", "id", "no."),
}
FEATURES = (
    "kind_email", "kind_ip", "kind_card", "kind_phone", "length", "digits", "letters", "blanks", "dots", "dashes",
    "slashes", "brackets", "plus", "ats", "groups", "longest_group", "shortest_group", "last_group", "luhn", "octets",
    "at_word", "dot_word", "letter_before", "letter_behind", "digit_near", *(f"near_{k}" for k in CONTEXT),
)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all spans that the generators propose; they may overlap."""
    if not _HINT.search(text):
        return []
    return [(kind, m.start(), m.end()) for kind, g in enumerate(GENERATORS) for m in g.finditer(text)]


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    kind, start, end = span
    s = text[start:end]
    digits = digits_of(s)
    groups = [len(g) for g in re.findall("[0-9]+", s)] or [0]
    before = text[max(0, start - 24) : start].lower()
    previous, behind = text[start - 1 : start], text[end : end + 1]
    near = text[max(0, start - 3) : start] + text[end : end + 3]
    lower = s.lower()
    dotted = re.split(r"[^0-9]+", s)
    return [
        *(float(kind == k) for k in range(4)),
        len(s), len(digits), sum(c.isalpha() for c in s), s.count(" "), s.count("."), s.count("-"), s.count("/"),
        sum(s.count(c) for c in "()[]{}"), s.count("+"), s.count("@"), len(groups), max(groups), min(groups), groups[-1],
        float(luhn(digits)) if digits else 0.0,
        float(len(dotted) == 4 and all(d and len(d) <= 3 and int(d) <= 255 for d in dotted)),
        float(bool(re.search(r"[([{]at[)\]}]", lower))), float(bool(re.search(r"[([{]dot[)\]}]|\x20dot\x20", lower))),
        float(previous.isalpha()), float(behind.isalpha()), float(bool(_DIGIT.search(near))),
        *(float(any(re.search(rf"\b{re.escape(w)}", before) for w in words)) for words in CONTEXT.values()),
    ]


# --- boosted trees ----------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class BoostedTrees:
    """Logistic gradient boosting with second-order leaf values over binned features."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    penalty: float = 1.0
    start: float = 0.0
    trees: list[dict[int, tuple]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = _sigmoid(score)
            tree: dict[int, tuple] = {}
            self._grow(tree, 1, np.arange(len(y)), binned, edges, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._tree(tree, x)
        return self

    def _grow(self, tree, node, rows, binned, edges, gradient, curve) -> None:
        g, h = gradient[rows], curve[rows]
        total_g, total_h = g.sum(), h.sum()
        best = (1e-6, None, None)
        if node < 2**self.depth and len(rows) >= 4:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                left_g = np.cumsum(np.bincount(b, g, len(e) + 1))[:-1]
                left_h = np.cumsum(np.bincount(b, h, len(e) + 1))[:-1]
                gain = (
                    left_g**2 / (left_h + self.penalty)
                    + (total_g - left_g) ** 2 / (total_h - left_h + self.penalty)
                    - total_g**2 / (total_h + self.penalty)
                )
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] is None:
            tree[node] = (None, -self.rate * float(total_g / (total_h + self.penalty)))
            return
        _, f, k = best
        tree[node] = (f, float(edges[f][k]))
        low = binned[rows, f] <= k
        self._grow(tree, 2 * node, rows[low], binned, edges, gradient, curve)
        self._grow(tree, 2 * node + 1, rows[~low], binned, edges, gradient, curve)

    def _tree(self, tree: dict[int, tuple], x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x)), [(1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            f, value = tree[node]
            if f is None:
                out[rows] = value
            else:
                low = x[rows, f] <= value
                todo += [(2 * node, rows[low]), (2 * node + 1, rows[~low])]
        return out

    def decide(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._tree(t, x) for t in self.trees), np.zeros(len(x)))


# --- training -----------------------------------------------------------------------------------------


def _luhn_number(rng: np.random.Generator, size: int, right: bool) -> str:
    body = "".join(map(str, rng.integers(0, 10, size - 1)))
    digit = next(d for d in "0123456789" if luhn(body + d))
    return body + (digit if right else str((int(digit) + int(rng.integers(1, 10))) % 10))


def seeded_examples(n: int = SYNTHETIC, seed: int = SEED) -> list[tuple[str, int, int]]:
    """(text, kind, label): ``n`` of each of some written forms, with words before and behind."""
    rng = np.random.default_rng(seed)

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def digits(k):
        return "".join(map(str, rng.integers(0, 10, k)))

    def name():
        return "".join(pick(*"abcdefghijklmnoprstuvw") for _ in range(int(rng.integers(3, 9))))

    def around(before, value, behind="and then the rest"):
        return f"{pick('so', 'the', 'it is', name())} {before} {value} {behind}"

    rows = []
    for _ in range(n):
        at, dot = pick(" (at) ", "(at)", " [at] ", "[at]"), pick(" (dot) ", "(dot)", " dot ", "[dot]", ".")
        rows.append((around(pick("mail", "write to", "contact", "reach"), f"{name()}{at}{name()}{dot}{pick('com', 'org', 'net')}"), 0, 1))
        rows.append((around(pick("look", "was", "stay", "were"), f"{name()} at {name()}{pick('.', '. ')}{name()}"), 0, 0))
        rows.append((around(pick("host", "server", "ip"), "[.]".join(str(rng.integers(0, 256)) for _ in range(4))), 1, 1))
        rows.append((around(pick("version", "see", "part"), ".".join(str(rng.integers(0, 1500)) for _ in range(3)) + "." + digits(4)), 1, 0))
        number = _luhn_number(rng, 15, True)
        rows.append((around(pick("card", "visa", "credit card", "payment"), f"{number[:4]} {number[4:10]} {number[10:]}"), 2, 1))
        rows.append((around(pick("order", "was", "id", "of", name()), _luhn_number(rng, int(rng.integers(13, 20)), False)), 2, 0))
        rows.append((around(pick("order", "id", "isbn", "invoice", name()), _luhn_number(rng, int(rng.integers(13, 16)), True)), 2, 0))
        dash = pick("-", ".", " ")
        rows.append((around(pick("call", "phone", "tel", "mobile", "fax"), pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}{dash}{digits(3)}{dash}{digits(4)}")), 3, 1))
        rows.append((around(pick("on", "date", "page", "total", "of", name()), pick(f"20{digits(2)}-{digits(2)}-{digits(2)}", digits(8), digits(int(rng.integers(4, 13))), f"{digits(2)}/{digits(2)}/20{digits(2)}", f"{digits(3)} {digits(3)}", f"{digits(3)}.{digits(3)}.{digits(3)}")), 3, 0))
    return rows


_DATE = re.compile(r"(?:19|20)[0-9]{2}([./-])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])")


def excluded(span: str, kind: int) -> bool:
    """Whether the format alone says that a candidate is no personal data of its kind."""
    digits = digits_of(span)
    if kind == 0:  # no top-level domain
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1]
        return len(last) < 2 or not last[0].isalpha()
    if kind == 1:
        return any(int(g) > 255 for g in re.findall("[0-9]+", span))
    if kind == 2:
        return not luhn(digits)
    return not 7 <= len(digits) <= 15 or bool(_DATE.fullmatch(span))


def _corpus_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and labels of the candidates of whole documents; a candidate that a pattern of its own
    kind finds is personal data, one that no pattern touches and whose format excludes it is not, and
    others are left out, as nobody has labelled them."""
    x, y = [], []
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py() or ""
            base = base_spans(text)
            for span in candidates(text):
                kind, start, end = span
                touched = [b for b in base if b[1] < end and start < b[2]]
                if span in base or not touched and excluded(text[start:end], kind):
                    x.append(np.array(features(text, span), np.float32).tobytes())
                    y.append(int(bool(touched)))
    yield pa.record_batch([pa.array(x, pa.binary()), pa.array(y, pa.int32())], names=["x", "y"])


@dataclass
class Detector:
    trees: BoostedTrees
    slope: float
    offset: float
    thresholds: list[float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.trees.decide(x) + self.offset)

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Spans of the patterns, and all spans, both by kind and start."""
        base = base_spans(text)
        free = [c for c in candidates(text) if not any(b[1] < c[2] and c[1] < b[2] for b in base)]
        if not free:
            return base, base
        chance = self.probability(np.array([features(text, c) for c in free], np.float64))
        taken = list(base)
        for p, c in sorted(zip(-chance, free)):
            if -p >= self.thresholds[c[0]] and not any(b[1] < c[2] and c[1] < b[2] for b in taken):
                taken.append(c)
        return base, sorted(taken)


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Detector:
    held = np.random.default_rng(seed).random(len(y)) < 0.3
    trees = BoostedTrees().fit(x[~held], y[~held])
    score, target = trees.decide(x[held]), y[held]
    # Calibration by Newton steps of a logistic fit with a little shrinkage.
    design, w = np.column_stack([score, np.ones(len(score))]), np.array([1.0, 0.0])
    for _ in range(25):
        p = _sigmoid(design @ w)
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(curve, design.T @ (p - target) + 1e-2 * (w - [1.0, 0.0]))
    chance = _sigmoid(design @ w)
    thresholds = []
    for kind in range(len(KINDS)):
        own = x[held][:, kind] == 1
        order = np.argsort(-chance[own], kind="stable")
        right = np.cumsum(target[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        thresholds.append(max(0.9, float(chance[own][order][good[-1]])) if len(good) else 2.0)
    return Detector(trees, float(w[0]), float(w[1]), thresholds)


def fit(df: DataFrame, text: str = "text", seed: int = SEED) -> Detector:
    """Train on a bounded sample of documents and on seeded examples."""
    python_ready(df.sparkSession)
    share = min(1.0, SAMPLE_DOCUMENTS / max(df.count(), 1))
    t = df.select(text_of(text).alias("text"))
    t = t.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).dropDuplicates(["text"])
    rows = t.mapInArrow(_corpus_rows, "x binary, y int").orderBy(F.xxhash64("x"), "x").limit(SAMPLE_CANDIDATES).collect()
    xs, ys = [np.frombuffer(r.x, np.float32).astype(float) for r in rows], [r.y for r in rows]
    for example, kind, label in seeded_examples(seed=seed):
        own = [c for c in candidates(example) if c[0] == kind]
        if own:
            xs.append(np.array(features(example, max(own, key=lambda c: c[2] - c[1])), float))
            ys.append(label)
    return train(np.array(xs), np.array(ys, float), seed)


def scanned(text: Column, detector: Detector) -> Column:
    """A struct of the number of pattern spans by kind and both span lists as strings."""
    names = [*(f"n_{k}" for k in KINDS), "base", "spans"]

    @F.arrow_udf("struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base:string,spans:string>")
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            base, spans = detector.spans(t.as_py() or "")
            rows.append((*(sum(b[0] == k for b in base) for k in range(len(KINDS))), written(base), written(spans)))
        kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return scan(text)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def op8_personal_data(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    detector = fit(docs)
    rows = docs.select("doc_id", scanned(text_of("text"), detector).alias("s"))
    return rows.select(
        quoted("doc_id"),
        *(F.col(f"s.n_{k}") for k in KINDS),
        F.sha2("s.base", 256).alias("base_sha256"),
        F.col("s.spans").alias("spans"),
    )
