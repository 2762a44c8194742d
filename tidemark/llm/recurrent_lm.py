"""Scoring documents with a gated recurrent language model.

Tokens are the lower-cased words of a text and one end. Counts of all training tokens are gathered on
Spark: they give the base score, the vocabulary and its classes, and the start of every output bias, and
they grow with the corpus. The recurrent network (one gated layer, class-factored output softmax: first
the class of a word, then the word within it) is trained in numpy by truncated backpropagation through time. A bounded sample
(``SAMPLE_TOKENS``) gives a common start; from there every training row is passed once on Spark, in
``ROUNDS`` parts: each task trains a copy on its rows of the part, and the copies, weighted by their
tokens, are averaged before the next part. In training, documents longer than a lane are cut into pieces that
learn side by side; the tokens before a piece are run again, to bring its state back. Words outside the network's vocabulary share one class;
inside it they have their smoothed share of the corpus counts.

Scoring runs whole documents side by side in lanes; the state is carried from window to window, so a
document's probability is that of its whole text, however long it is. The ``FREQUENT`` most frequent
words, a bounded table, go to every task; rarer words are joined with the counts on Spark, a row for
each document and word, so the frequent keys never meet in one task.

Defined cases: a null or empty text is one end; null ids belong to the training rows; repeated rows are
scored each for itself and count as often as they come; without training rows there is no network and
both scores are those of the smoothed counts alone; an empty table gives an empty table; other columns
of the input are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, python_ready, quoted, text_of
from tidemark.session import materialize

END = " "  # no word has a blank
FREQUENT = 1 << 16  # words, and so the rows of the table, are fewer
VOCABULARY = 2046
CLASSES = 45
HIDDEN = 24
EMBEDDING = 16
SAMPLE_TOKENS = 400_000
EPOCHS = 2
ROUNDS = 4
ROUND_RATE = 0.004  # of the first round; halved from round to round
ROUND_LANES = 256
HELD_TOKENS = 400_000  # that a task trains on at once
LEAST_PIECE = 240  # tokens of a document that training keeps together at least
BEHIND = 24  # tokens before a piece that bring its state back
BLOCKS = 2048  # in which parameters are averaged
LANES = 1024
WINDOW = 64
AT_ONCE = 16  # steps of a window whose logits stay in a processor's cache
BUFFERED_TOKENS = 2_000_000
DISTINCT_HELD = 400_000
SEED = 29


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z alone), split at the six ASCII blanks."""
    return (text or "").encode().lower().split()


def batch_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same for a batch without nulls: all words one behind another, and the place of each word's text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, owners = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), owners.filter(full).to_numpy()


def batch_ids(found: pa.Array, owners: np.ndarray, rows: int, end: int, missing: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of a batch with an end behind every text, and where each text's ids begin (and the last end)."""
    bounds = np.append(0, np.cumsum(np.bincount(owners, minlength=rows) + 1))
    ids = np.full(bounds[-1], end, np.int32)
    ids[np.arange(len(owners)) + owners] = found.fill_null(missing).to_numpy()
    return ids, bounds


# --- counts ------------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of a task, given out whenever many distinct words are held."""
    held: list[pa.Table] = []

    def together() -> pa.Table:
        whole = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return whole.select(["word", "n_sum"]).rename_columns(["word", "n"])

    for batch in batches:
        texts = batch.column(0)
        counted = batch_tokens(texts)[0].value_counts()
        held.append(pa.table({"word": counted.field("values"), "n": counted.field("counts")}))
        held.append(pa.table({"word": [END], "n": [len(texts)]}))
        if sum(map(len, held)) > DISTINCT_HELD:
            held = [together()]
            if len(held[0]) > DISTINCT_HELD * 3 // 4:
                yield from held.pop().to_batches()
    if held:
        yield from together().to_batches()


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    counted = df.select(text_of(text).alias("text")).mapInArrow(_count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Unigrams:
    """The counts as far as every task needs them."""

    total: int  # N
    distinct: int  # V
    words: list[bytes]  # the most frequent, by count
    counts: np.ndarray

    def log10(self, counts):
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def unigrams(counts: DataFrame, frequent: int = FREQUENT) -> Unigrams:
    """The words with the highest counts, fewer than ``frequent``, and the end, which stands among the
    words of the network's vocabulary, however rare it is.

    The lowest count of a frequent word is found from the number of words by steps of their count, a
    few hundred rows, so that no task hands its own list of frequent words to the driver.
    """
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    is_end = F.col("word") == END
    step = F.floor(F.log2("n") * 16)
    rows = counts.filter(~is_end).groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n"))
    lowest, held = None, 0
    for row in sorted(rows.collect(), key=lambda r: -r.step):
        held += row.words
        if held >= frequent:
            break
        lowest = row.n
    top = [] if lowest is None else counts.filter(~is_end & (F.col("n") >= lowest)).collect()
    pairs = sorted(((r.word.encode(), r.n) for r in top), key=lambda p: (-p[1], p[0]))
    for r in counts.filter(is_end).collect():  # one row at most
        rank = sum(n >= r.n for _, n in pairs)
        pairs.insert(min(rank, VOCABULARY - 1), (END.encode(), r.n))
    return Unigrams(sums.n or 0, sums.v, [w for w, _ in pairs], np.array([n for _, n in pairs], np.float64))


# --- the network ---------------------------------------------------------------------------------------


def _by_gate(values: np.ndarray) -> np.ndarray:
    """Rows of update, reset and candidate as three tables."""
    return values.reshape(len(values), 3, HIDDEN).swapaxes(0, 1)


class Adam:
    """Steps of Adam with the gradient cut to the norm 1."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        self.steps = 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
        cut = min(1.0, 1.0 / max(norm, 1e-12))
        size = rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k, v in g.items():
            m, s = self.moments[k]
            v *= 0.1 * cut
            m *= 0.9
            m += v
            v *= v  # a hundredth of the squared gradient
            s *= 0.99
            s += v
            np.sqrt(s, out=v)
            v += 1e-6
            np.divide(m, v, out=v)
            v *= size
            p[k] -= v


class GatedNetwork:
    """A gated recurrent layer with a class-factored softmax over ids.

    Ids 0 .. n-1 are words in the order of their frequency, each in a class of neighbours of about the
    same share; id n, alone in the last class, stands for every other word. Before its first token a
    document has the state 0, and the state before a token predicts it.
    """

    def __init__(self, counts: np.ndarray, others: float, end: int, seed: int = SEED):
        self.n, self.end = len(counts), end
        share = np.append(counts + 0.5, others)
        share = share / share.sum()
        cumulative = np.cumsum(share[: self.n]) / max(share[: self.n].sum(), 1e-12)
        by_share = np.minimum((cumulative * CLASSES).astype(int), CLASSES - 1)
        _, self.class_of = np.unique(by_share, return_inverse=True)
        self.class_of = np.append(self.class_of, self.class_of.max() + 1 if self.n else 0).astype(np.int64)
        self.starts = np.searchsorted(self.class_of, np.arange(self.class_of.max() + 2))
        classes = self.class_of.max() + 1
        draw = np.random.default_rng(seed)
        small = lambda *shape: (draw.standard_normal(shape) * 0.1).astype(np.float32)
        mass = np.bincount(self.class_of, share)
        self.p = {
            "embedding": small(self.n + 1, EMBEDDING),
            "input": small(EMBEDDING, 3 * HIDDEN),
            "gate_bias": np.zeros(3 * HIDDEN, np.float32),
            "state": small(HIDDEN, 3 * HIDDEN),
            "class": np.zeros((HIDDEN, classes), np.float32),
            "class_bias": np.log(mass).astype(np.float32),
            "word": np.zeros((HIDDEN, self.n + 1), np.float32),
            "word_bias": np.log(share / mass[self.class_of]).astype(np.float32),
        }

    def table(self) -> np.ndarray:
        """What each id adds to the gates."""
        return self.p["embedding"] @ self.p["input"] + self.p["gate_bias"]

    def gates(self) -> np.ndarray:
        """The same by gate, id and unit."""
        return np.ascontiguousarray(_by_gate(self.table()))

    def step(self, h: np.ndarray, x: np.ndarray):
        """The next state, and what the way back needs."""
        return self._step(h, _by_gate(x), _by_gate(self.p["state"]))

    @staticmethod
    def _step(h: np.ndarray, x: np.ndarray, state: np.ndarray):
        a = h @ state
        zr = x[:2] + a[:2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c = zr[1] * a[2]
        c += x[2]
        np.tanh(c, out=c)
        after = c - h
        after *= zr[0]
        after += h
        return after, (zr[0], zr[1], c, a[2])

    def log_probability(self, h: np.ndarray, ids: np.ndarray, gradient: dict | None = None) -> np.ndarray:
        """Natural log probability of each id from the state before it (rows). With ``gradient``, what the
        loss asks of the parameters is added there and of the states under "h"."""
        p = self.p
        # By class, and one column for each row: sums over words run along rows. A one behind each state brings the bias.
        order = np.argsort(self.class_of[ids].astype(np.uint16), kind="stable")
        ids, by_class = ids[order], np.ones((len(ids), HIDDEN + 1), h.dtype)
        by_class[:, :HIDDEN] = h[order]
        class_weights, word_weights = np.vstack([p["class"], p["class_bias"]]), np.vstack([p["word"], p["word_bias"]])
        classes, rows, learning = self.class_of[ids], np.arange(len(ids)), gradient is not None
        e, found = self._softmax(class_weights.T @ by_class.T, classes, rows, learning)
        if learning:
            e[classes, rows] -= 1
            of_classes, of_words = by_class.T @ e.T, np.zeros_like(word_weights)
            asked = e.T @ p["class"].T
        bounds = np.searchsorted(classes, np.arange(len(self.starts)))
        for k in range(len(self.starts) - 1):
            a, b = self.starts[k], self.starts[k + 1]
            own = slice(bounds[k], bounds[k + 1])
            if b - a < 2 or own.start == own.stop:
                continue
            part, within, at = by_class[own], ids[own] - a, rows[: own.stop - own.start]
            e, inner = self._softmax(word_weights[:, a:b].T @ part.T, within, at, learning)
            found[own] += inner
            if learning:
                e[within, at] -= 1
                np.matmul(part.T, e.T, out=of_words[:, a:b])
                asked[own] += e.T @ p["word"][:, a:b].T
        if learning:
            for name, values in (("class", of_classes), ("word", of_words)):
                gradient[name] += values[:HIDDEN]
                gradient[name + "_bias"] += values[HIDDEN]
        result = np.empty_like(found)
        result[order] = found
        if learning:
            gradient["h"] = np.empty_like(asked)
            gradient["h"][order] = asked
        return result

    @staticmethod
    def _softmax(logits: np.ndarray, chosen: np.ndarray, columns: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of the chosen probability of each column and, if asked for, all probabilities in place."""
        logits -= logits.max(axis=0)
        found = logits[chosen, columns]
        np.exp(logits, out=logits)
        total = logits.sum(axis=0)
        found -= np.log(total)
        if whole:
            logits *= 1 / total
        return logits, found

    def train(self, docs: list[np.ndarray], epochs: int = EPOCHS, lanes: int = 32, window: int = 24, rate: float = 0.01):
        """Truncated backpropagation through time with Adam over documents packed into lanes. The rate is
        halved from pass to pass; every tenth document is kept back, and the parameters of the pass (or
        of the start) that predict those best stay."""
        kept = docs[9::10]
        docs = [d for k, d in enumerate(docs) if k % 10 != 9]
        best = (self.score(kept).sum(), {k: v.copy() for k, v in self.p.items()})
        rng, adam = np.random.default_rng(SEED), Adam(self.p)
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            self.learn([docs[k] for k in order], adam, lanes, window, rate * 0.5**epoch)
            if not kept or (now := self.score(kept).sum()) > best[0]:
                best = (now if kept else 0.0, {k: v.copy() for k, v in self.p.items()})
        self.p = best[1]
        return self

    def learn(self, docs: list[np.ndarray], adam: Adam, lanes: int, window: int, rate: float) -> None:
        """One pass over the documents, long ones in pieces, so that no lane runs on alone."""
        packed = Lanes(pieces(docs, lanes, self.end), lanes, self.end)
        h = np.zeros((packed.lanes, HIDDEN), np.float32)
        for t in range(0, packed.steps, window):
            ids, on, _ = packed.window(t, window)
            silent = ids < 0
            ids, on = np.where(silent, ~ids, ids), on & ~silent
            h, g = self._window(h[: ids.shape[1]], ids, on)
            adam.step(self.p, g, rate)

    def flat(self) -> np.ndarray:
        """All parameters in one row."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def _window(self, h: np.ndarray, ids: np.ndarray, on: np.ndarray):
        """The state behind a window and the mean gradient of its tokens; nothing flows back before it."""
        p, (steps, n) = self.p, ids.shape
        places = ids.ravel()
        x, to_state = self.gates().take(places, axis=1, mode="clip"), _by_gate(p["state"])
        states, z, r, c, a = np.empty((5, steps, n, HIDDEN), h.dtype)
        ends = ids == self.end
        for t in range(steps):
            states[t] = h
            h, (z[t], r[t], c[t], a[t]) = self._step(h, x[:, t * n : (t + 1) * n], to_state)
            h[ends[t]] = 0
        g = {k: np.zeros_like(v) for k, v in p.items()}
        flat, total = on.ravel(), max(int(on.sum()), 1)
        if total == len(flat):
            flat = slice(None)
        all_states = states.reshape(-1, HIDDEN)
        self.log_probability(all_states[flat], places[flat], g)
        asked = g.pop("h")
        if total < len(all_states):
            asked, some = np.zeros_like(all_states), asked
            asked[flat] = some
        asked = asked.reshape(states.shape)
        # What a state is asked for, times these, is asked of the candidate and, by gate, of what the state gave.
        candidate = z * (1 - c * c)
        factors = np.empty((steps, 4, n, HIDDEN), h.dtype)
        stays = 1 - z
        np.multiply(candidate, r, out=factors[:, 0])
        np.multiply((c - states) * z, stays, out=factors[:, 1])
        np.multiply(factors[:, 0] * a, 1 - r, out=factors[:, 2])
        backs, from_state = np.empty_like(states), np.ascontiguousarray(to_state[[2, 0, 1]].swapaxes(1, 2))
        back = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            back[ends[t]] = 0
            backs[t] = back
            own = factors[t, :3]
            own *= back
            back *= stays[t]
            back += asked[t]
            for part in own @ from_state:
                back += part
        # One product for what the inputs, the states and the bias give: the candidate's state part, update, reset,
        # candidate.
        np.multiply(backs, candidate, out=factors[:, 3])
        dx = np.ascontiguousarray(factors.swapaxes(1, 2)).reshape(-1, 4 * HIDDEN)
        given = np.concatenate([all_states, p["embedding"][places], np.ones((len(places), 1), h.dtype)], axis=1)
        product = given.T @ dx
        g["state"] += np.roll(product[:HIDDEN, : 3 * HIDDEN], -HIDDEN, axis=1)
        g["input"] += product[HIDDEN:-1, HIDDEN:]
        g["gate_bias"] += product[-1, HIDDEN:]
        for k, column in enumerate(p["input"] @ dx[:, HIDDEN:].T):
            g["embedding"][:, k] = np.bincount(places, column, len(g["embedding"]))
        scale = np.float32(1 / total)
        return h, {k: v * scale for k, v in g.items()}

    def score(self, docs: list[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
        """The log10 probability of each document (ids with the end)."""
        if not docs:
            return np.zeros(0)
        packed = Lanes(docs, lanes, self.end)
        gates, to_state, sums = self.gates(), _by_gate(self.p["state"]), np.zeros(len(docs))
        h = np.zeros((packed.lanes, HIDDEN), np.float32)
        for t in range(0, packed.steps, window):
            ids, on, owner = packed.window(t, window)
            n = ids.shape[1]
            h, states = h[:n], np.empty((len(ids), n, HIDDEN), np.float32)
            for k, step in enumerate(ids):
                states[k] = h
                h, _ = self._step(h, gates.take(step, axis=1, mode="clip"), to_state)
                h[step == self.end] = 0
            for k in range(0, len(ids), AT_ONCE):
                live = on[k : k + AT_ONCE]
                found = self.log_probability(states[k : k + AT_ONCE][live], ids[k : k + AT_ONCE][live])
                sums += np.bincount(owner[k : k + AT_ONCE][live], found, len(docs))
        return sums / np.log(10)


class Lanes:
    """Documents one behind another in lanes of like length, longest lane first. What is held are their
    tokens; a grid of steps and lanes is made for one window and its live lanes alone."""

    def __init__(self, docs: list[np.ndarray], lanes: int, fill: int):
        lanes = max(1, min(lanes, len(docs)))
        heap = [(0, k) for k in range(lanes)]
        queues: list[list[int]] = [[] for _ in range(lanes)]
        for d in sorted(range(len(docs)), key=lambda d: (-len(docs[d]), d)):
            length, k = heapq.heappop(heap)
            queues[k].append(d)
            heapq.heappush(heap, (length + len(docs[d]), k))
        heap.sort(key=lambda x: (-x[0], x[1]))
        order = [d for _, k in heap for d in queues[k]]
        self.lanes, self.steps, self.fill = lanes, heap[0][0], fill
        self.lengths = np.array([n for n, _ in heap])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = np.concatenate([docs[d] for d in order] or [np.zeros(0, np.int32)]).astype(np.int32)
        self.owner = np.repeat(np.array(order, np.int32), [len(docs[d]) for d in order])

    def window(self, t: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids by (step, lane) from step ``t`` on, which of them are real, and the document of each."""
        n = int((self.lengths > t).sum())
        at = np.arange(t, min(t + size, self.steps))[:, None]
        live = at < self.lengths[:n]
        places = np.minimum(self.starts[:n] + at, max(len(self.ids) - 1, 0))
        return np.where(live, self.ids[places], np.int32(self.fill)), live, np.where(live, self.owner[places], 0)


def pieces(docs: list[np.ndarray], lanes: int, end: int) -> list[np.ndarray]:
    """Documents cut to about the length of a lane, every token in one piece. A piece starts with the tokens before
    it, which bring the state back, and one that goes on elsewhere has an end behind it; these additions, which are
    run and not learnt, are given as their complements."""
    length = max(LEAST_PIECE, -(-sum(map(len, docs)) // lanes))
    found = []
    for doc in docs:
        for at in range(0, len(doc), length):
            stop = at + length
            found.append(np.concatenate([~doc[max(at - BEHIND, 0) : at], doc[at:stop], np.full(int(stop < len(doc)), ~end, doc.dtype)]))
    return found


def pack(docs: list[np.ndarray], lanes: int, fill: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All steps of the lanes at once, for few and short documents."""
    packed = Lanes(docs, lanes, fill)
    return packed.window(0, packed.steps)


# --- fitting and scoring ----------------------------------------------------------------------------------


@dataclass
class Model:
    known: Unigrams
    network: GatedNetwork | None
    others_shift: float  # log10 of the whole mass over that of the words outside the vocabulary


def sample_documents(train: DataFrame, text: str, total_tokens: int, wanted: int = SAMPLE_TOKENS) -> list[list[bytes]]:
    """About ``wanted`` tokens of whole documents, chosen by a hash of the text, copies once."""
    share = min(1.0, wanted / max(total_tokens, 1))
    t = train.select(text_of(text).alias("text"))
    t = t.filter(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    docs, held = [], 0
    for row in t.dropDuplicates(["text"]).orderBy(F.xxhash64("text")).toLocalIterator():
        docs.append(tokens(row.text))
        held += len(docs[-1])
        if held > 2 * wanted:
            break
    return docs


def _ids(words: list[bytes], place: dict[bytes, int], network: GatedNetwork) -> np.ndarray:
    ids = np.empty(len(words) + 1, np.int32)
    ids[:-1] = list(map(place.get, words, repeat(network.n)))
    ids[-1] = network.end
    return ids


def _round(shared, rate: float):
    """A mapInArrow function: a copy of the network trained on the rows of the task, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, words = shared.value
        known = pa.array([w.decode() for w in words], pa.string())
        adam, docs, held, total = Adam(network.p), [], 0, 0
        network.p = {k: v.copy() for k, v in network.p.items()}
        for batch in batches:
            found, owners = batch_tokens(batch.column(0))
            ids, bounds = batch_ids(pc.index_in(found, known), owners, len(batch), network.end, network.n)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                docs.append(ids[a:b])
                held += b - a
                if held > HELD_TOKENS:
                    network.learn(docs, adam, ROUND_LANES, 24, rate)
                    total, held, docs = total + held, 0, []
        if docs:
            network.learn(docs, adam, ROUND_LANES, 24, rate)
            total += held
        if total:
            parts = np.array_split(network.flat(), BLOCKS)
            yield pa.record_batch(
                [
                    pa.array(range(BLOCKS), pa.int32()), pa.array([total] * BLOCKS, pa.int64()),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                ],
                names=["block", "n", "part"],
            )

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the blocks, weighted by the tokens; all copies of a block are in this task."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, n, part in zip(*(c.to_pylist() for c in batch.columns)):
            own = sums.setdefault(block, [0, 0.0])
            own[0] += n
            own[1] = own[1] + n * np.frombuffer(part, np.float32).astype(np.float64)
    means = [(total / n).astype(np.float32).tobytes() for n, total in sums.values()]
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(means, pa.binary())], names=["block", "part"])


def train_on_all(train: DataFrame, network: GatedNetwork, words: list[bytes], text: str = "text") -> None:
    """One pass over every training row, in rounds; a row's round is told by a hash of its text."""
    spark = train.sparkSession
    rows = train.select(text_of(text).alias("text"))
    part = F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(ROUNDS))
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((network, words))  # bounded by the network's size
        run = _round(shared, ROUND_RATE * 0.5**k)
        copies = rows.filter(part == k).mapInArrow(run, "block int, n bigint, part binary")
        copies = materialize(copies, "network-copies")
        means = copies.repartition("block").sortWithinPartitions("block", "n", "part")
        means = materialize(means.mapInArrow(_averaged, "block int, part binary"), "network")
        found = {r.block: r.part for r in means.collect()}
        if found:
            network.set_flat(np.concatenate([np.frombuffer(found[b], np.float32) for b in range(BLOCKS)]))
        shared.destroy()


def fit(train: DataFrame, counts: DataFrame, text: str = "text") -> Model:
    """``counts`` are the written token counts of ``train``."""
    known = unigrams(counts)
    if not known.total:
        return Model(known, None, 0.0)
    inside = known.words[:VOCABULARY]
    place = {w: k for k, w in enumerate(inside)}
    own = known.counts[: len(inside)]
    others = max(known.total - own.sum() + 0.5 * (known.distinct - len(inside) + 1), 0.5)
    network = GatedNetwork(own, others, place[END.encode()])
    docs = sample_documents(train, text, known.total)
    network.train([_ids(d, place, network) for d in docs])
    train_on_all(train, network, inside, text)
    whole = known.total + 0.5 * (known.distinct + 1)
    return Model(known, network, float(np.log10(whole / others)))


def _scorer(shared):
    """A mapInArrow function: a row for each document (word null), and one for each document and rare word."""
    schema = pa.schema(
        [
            ("row", pa.int64()), ("id", pa.int64()), ("word", pa.string()), ("n", pa.int64()),
            ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model: Model = shared.value
        known, network = model.known, model.network
        words = pa.array([w.decode() for w in known.words], pa.string())
        logs = np.append(known.log10(known.counts), 0.0)  # the last for -1, words that are not frequent
        inside = network.n if network else 0
        end = known.words.index(END.encode()) if END.encode() in known.words else -1
        first = TaskContext.get().partitionId() << 40
        docs, rows, held = [], [], 0

        def given(**columns) -> pa.RecordBatch:
            n = len(columns["row"])
            arrays = [columns.get(f.name, pa.nulls(n, f.type)) for f in schema]
            arrays = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in arrays]
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(arrays, schema)]
            return pa.record_batch(arrays, schema=schema)

        def flush() -> pa.RecordBatch:
            nonlocal held
            row, id_, n, n_known, base, score = zip(*rows)
            row, n, n_known, base, score = (np.concatenate(c) for c in (row, n, n_known, base, score))
            if network:
                score = score + network.score(docs)
            batch = given(row=row, id=pa.concat_arrays(id_), n=n, n_known=n_known, base=base, score=score)
            docs.clear(), rows.clear()
            held = 0
            return batch

        for batch in batches:
            found, owners = batch_tokens(batch.column(1))
            ids, bounds = batch_ids(pc.index_in(found, words), owners, len(batch), end, -1)
            lengths = np.diff(bounds)
            owner = np.repeat(np.arange(len(batch)), lengths)
            sums = lambda values: np.bincount(owner, values, len(batch))
            frequent, logged, row = ids >= 0, logs[ids], first + np.arange(len(batch))
            base = sums(logged)
            score = base
            if network:
                outside = ~frequent | (ids >= inside)
                score = sums(np.where(outside, logged + model.others_shift, 0.0))
                ids = np.where(outside, np.int32(network.n), ids)
                docs.extend(ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            rows.append((row, batch.column(0), lengths, sums(frequent).astype(np.int64), base, score))
            first, held = first + len(batch), held + len(ids)
            rare = ~frequent[np.arange(len(owners)) + owners]
            rare = pa.table({"row": row[owners[rare]], "word": found.filter(pa.array(rare))})
            rare = rare.group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")])
            yield given(row=rare["row"], word=rare["word"], n=rare["count_all"])
            if end < 0:
                yield given(row=row, word=[END] * len(row), n=np.ones(len(row), np.int64))
            if held > BUFFERED_TOKENS:
                yield flush()
        if rows:
            yield flush()

    return run, "row bigint, id bigint, word string, n bigint, n_known bigint, base double, score double"


def scored(df: DataFrame, model: Model, counts: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, base_score, score."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by FREQUENT and the network's size
    run, schema = _scorer(shared)
    parts = df.select(quoted(id_).cast("bigint").alias("id"), text_of(text).alias("text")).mapInArrow(run, schema)
    parts = materialize(parts, "score-parts")
    known = model.known
    whole = F.lit(float(known.total + 0.5 * (known.distinct + 1)))
    rare = parts.filter("word IS NOT NULL").select("row", "word", "n")
    rare = rare.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10((c + 0.5) / whole)).alias("rare_base"),
    )
    rows = parts.filter("word IS NULL").join(sums, "row", "left")
    zero = F.lit(0)
    return rows.select(
        F.col("id").alias(id_),
        F.col("n").alias("n_tokens"),
        (F.col("n_known") + F.coalesce("rare_known", zero)).alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_base", zero)).alias("score"),
    )


def is_held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 1, F.lit(False))


def op5_recurrent_lm(spark, folder: str) -> DataFrame:
    python_ready(spark)
    docs = documents(spark, folder)
    train = docs.filter(~is_held_out(F.col("doc_id")))
    counts = materialize(token_counts(train), "token-counts")
    model = fit(train, counts)
    result = scored(docs, model, counts)
    return result.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.known.total).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
