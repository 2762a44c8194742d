"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A text is split by the tokenizer's pattern, and each piece is encoded by itself. Every byte prefix of a
piece has one encoding, so it has one last token: the token that ends there and stands validly behind
the last token of the prefix before it. Two neighbouring tokens are valid when merging their bytes
gives back these two tokens, and a sequence is the encoding exactly when all its neighbours are valid.
The table of last tokens is therefore filled from left to right in time linear in the bytes, however
long a piece is; bytes appended to a piece only extend the table, and after an edit only the pieces it
touches are filled again (``EncodedText``).

On Spark, encoding and decoding are scalar Arrow functions: nothing shuffles, a batch is all that a
task holds, and a task that is run again gives the same rows. Encodings of short pieces are kept in a
bounded cache of the worker.

Defined cases: a null or empty text has no ids and decodes to no bytes; other columns, also ones named
like the results, pass unchanged (results get a fresh name); an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, fresh, python_ready, quoted, text_of

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
CACHED_PIECES = 200_000
CACHED_LENGTH = 64
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


class Vocabulary:
    """Ranks of byte strings, and what the dynamic programme asks of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.split_from = regex.compile(pattern).finditer
        # Every ending of a token, with the token that it is, or -1 if it is none that merging leads to.
        self.endings = {t[i:]: -1 for t in ranks for i in range(len(t))}
        self.endings |= {t: rank for t, rank in ranks.items() if self.merged(t) == [rank]}
        self._valid: dict[int, bool] = {}
        self._spines: dict[tuple[int, int], list[int]] = {}
        self.pieces = PieceCache(self.encode_piece)

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """Merging step by step, down to ``stop`` parts: the pair of lowest rank first, the leftmost of
        equal ones. Quadratic, for short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            options = [
                (rank, i) for i in range(len(parts) - 1) if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None
            ]
            if not options:
                break
            _, i = min(options)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int, side: int) -> list[int]:
        """The tokens that a token's first (side 0) or last (side -1) byte belongs to while it is merged,
        from the byte to the token."""
        found = self._spines.get((token, side))
        if found is None:
            data = self.bytes_of[token]
            found = [token]
            if len(data) > 1:
                found = self.spine(self.merged(data, 2)[side], side) + found
            self._spines[token, side] = found
        return found

    def valid(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens (each of which merges to itself) gives back the two.

        It does unless, at some time, the parts beside the border have a merge of lower rank than the
        next merge that either of them has inside its own token; at equal ranks the left one comes first.
        """
        key = left << 24 | right
        found = self._valid.get(key)
        if found is None:
            if len(self._valid) > 2_000_000:
                self._valid.clear()
            a, b, i, j = self.spine(left, -1), self.spine(right, 0), 0, 0
            never = 1 << 60
            while True:
                across = self.ranks.get(self.bytes_of[a[i]] + self.bytes_of[b[j]], never)
                next_a = a[i + 1] if i + 1 < len(a) else never
                next_b = b[j + 1] if j + 1 < len(b) else never
                if across < never and across < next_a and across <= next_b:
                    found = False
                    break
                if next_a == next_b == never:
                    found = True
                    break
                if next_a <= next_b:
                    i += 1
                else:
                    j += 1
            self._valid[key] = found
        return found

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes merge to it."""
        return self.endings[self.bytes_of[token]] == token

    def fill(self, data: bytes, last: list[int]) -> list[int]:
        """Extend ``last``, the last token of each prefix of ``data`` (place 0 stands for no bytes), to its end."""
        ending, known = self.endings.get, self._valid.get
        for end in range(len(last), len(data) + 1):
            start = end - 1
            while (token := ending(data[start:end])) is not None and start >= 0:
                if token >= 0:
                    if not start:
                        break
                    fits = known(last[start] << 24 | token)
                    if fits is None:
                        fits = self.valid(last[start], token)
                    if fits:
                        break
                start -= 1
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
            last.append(token)
        return last

    def read_back(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        ids, end = [], len(last) - 1
        while end > 0:
            ids.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return ids[::-1]

    def encode_piece(self, piece: str) -> bytes:
        data = piece.encode()
        # A piece that is a token keeps its rank even if merging does not lead to it.
        token = self.ranks.get(data)
        ids = [token] if token is not None else self.read_back(self.fill(data, [-1]))
        return np.array(ids, "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that the cache lacks: in order, so that each keeps the table of the prefix that
        it shares with the one before."""
        before, last = b"", [-1]
        known, old = self.pieces, self.pieces.old
        new = [p for p in pieces if p not in known and p not in old and len(p) <= CACHED_LENGTH]
        for data in sorted(p.encode() for p in new):
            token = self.ranks.get(data)
            if token is not None:
                ids = [token]
            else:
                most, same = min(len(data), len(last) - 1), 0
                while same < most and data[same] == before[same]:
                    same += 1
                del last[same + 1 :]
                ids, before = self.read_back(self.fill(data, last)), data
            self.pieces.store(data.decode(), array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes())

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode_all(self, texts: list[str], together: int = 500) -> list[bytes]:
        """The same for many texts, whose new pieces are encoded together."""
        known, result = self.pieces, []
        for k in range(0, len(texts), together):
            split = [self.split(t) for t in texts[k : k + together]]
            self.learn({p for pieces in split for p in pieces})
            result += [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        return result

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class PieceCache(dict):
    """Results of a function of short strings, in two generations of bounded size."""

    def __init__(self, compute: Callable, limit: int = CACHED_PIECES):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.compute(piece)
        self.store(piece, value)
        return value

    def store(self, piece, value) -> None:
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = value


class EncodedText:
    """An encoding kept with its tables, for exact appends and edits that redo only what they touch."""

    # A piece depends on its own characters and on at most this many behind it.
    LOOK_AHEAD = 3

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        self.append(text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> None:
        """Put ``text`` in place of the code points from ``start`` to ``end``."""
        v, old = self.vocabulary, self.text
        new = old[:start] + text + old[end:]
        ends = [*self.starts[1:], len(old)]
        keep = 0
        while keep < len(self.starts) and ends[keep] + self.LOOK_AHEAD <= start:
            keep += 1
        shift = len(new) - len(old)
        places = {s: k for k, s in enumerate(self.starts) if s >= end}
        starts, tables, rest = self.starts[:keep], self.tables[:keep], len(self.starts)
        for n, match in enumerate(v.split_from(new, self.starts[keep] if keep < len(self.starts) else len(old))):
            if (again := places.get(match.start() - shift)) is not None and match.start() >= start + len(text):
                rest = again
                break
            table = [-1]
            if n == 0 and keep < len(self.starts):
                # The first piece begins where an old one does; what they share keeps its tokens.
                a = match.group().encode()
                b = old[self.starts[keep] : ends[keep]].encode()
                same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                table = self.tables[keep][: same + 1]
            starts.append(match.start())
            tables.append(v.fill(match.group().encode(), table))
        self.starts = starts + [s + shift for s in self.starts[rest:]]
        self.tables = tables + self.tables[rest:]
        self.text = new

    def ids(self) -> list[int]:
        v, out = self.vocabulary, []
        ends = [*self.starts[1:], len(self.text)]
        for start, end, table in zip(self.starts, ends, self.tables):
            token = v.ranks.get(self.text[start:end].encode())
            out += [token] if token is not None else v.read_back(table)
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def vocabulary(name: str = DEFAULT_RANKS, pattern: str | None = None) -> Vocabulary:
    """The vocabulary of a worker; ``name`` is a file of the installed public tokenizers."""
    import public_tokenizers

    return Vocabulary(read_ranks(public_tokenizers.path(name)), pattern or public_tokenizers.PATTERN)


def encoded(text: Column, name: str = DEFAULT_RANKS, pattern: str | None = None) -> Column:
    """Ids of a text column as little-endian unsigned 32-bit integers in a binary column."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(vocabulary(name, pattern).encode_all([t or "" for t in texts.to_pylist()]), pa.binary())

    # Called non-deterministic so that an expression over its result reads it and does not encode again.
    return encode.asNondeterministic()(text)


def decoded(ids: Column, name: str = DEFAULT_RANKS, pattern: str | None = None) -> Column:
    """The bytes that encoded ids stand for."""

    @F.arrow_udf("binary")
    def decode(values: pa.Array) -> pa.Array:
        v = vocabulary(name, pattern)
        return pa.array([v.decode(x.as_py()) if x.is_valid else b"" for x in values], pa.binary())

    return decode(ids)


def encode_documents(df: DataFrame, text: str = "text", name: str = DEFAULT_RANKS) -> DataFrame:
    """``df`` with a column ``ids`` (or a fresh name) behind its own."""
    python_ready(df.sparkSession)
    (ids,) = fresh(df, "ids")
    return df.withColumn(ids, encoded(text_of(text), name))


def decode_documents(df: DataFrame, ids: str = "ids", name: str = DEFAULT_RANKS) -> DataFrame:
    """``df`` with a column ``decoded`` (or a fresh name) behind its own."""
    python_ready(df.sparkSession)
    (out,) = fresh(df, "decoded")
    return df.withColumn(out, decoded(quoted(ids), name))


def n_ids(ids: str) -> Column:
    return (F.octet_length(quoted(ids)) / 4).cast("bigint")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: id, number of tokens and the ids of every document, in Base64 as the table is
    meant to be compared and moved as text."""
    rows = encode_documents(docs.select(quoted("doc_id"), quoted("text")))
    return rows.select("doc_id", n_ids("ids").alias("n_tokens"), F.base64("ids").alias("ids_base64"))


def op1_byte_bpe(spark, folder: str) -> DataFrame:
    rows = decode_documents(encode_documents(documents(spark, folder).select("doc_id", "text")))
    return rows.select(
        "doc_id",
        n_ids("ids").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
