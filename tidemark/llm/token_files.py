"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits. Level 0 has the lowest chunk of every id; a bitmap tells which
ids go on, and level 1 has the next chunk of those alone, and so on. With the ones of each bitmap
counted up to every 512th place, the rank of a place in the bitmap is its place in the next level, so
any id is found in a few steps and any range of ids by slicing, without decoding a block.

A file (a shard) is: the magic bytes, the length of a JSON header, the header (the place and type of each
array), and the arrays: document ids and their null flags, document starts, and for each level its
chunks, bitmap and rank directory.

Writing ranges documents by id, sorts each range and writes shards of bounded size to the shared
folder; a shard gets its name by an atomic move, and a task that runs again writes the same shards
again. The manifest, a table with a row for each shard, is written when all are there; running sums
over it give the global place of each shard.

Defined cases: a null or empty text has the end id alone; null document ids come first; equal ids are
ordered by their texts; an empty table gives no shard; other columns of the input are not read.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.byte_bpe import CACHED_LENGTH, CACHED_PIECES
from tidemark.llm.common import documents, python_ready, quoted, text_of
from tidemark.session import materialize, scratch_path

MAGIC = b"TMDAC001"
BLOCK = 512
SHARD_IDS = 8_000_000
ENCODED_BYTES = 20 << 20
DEFAULT_TOKENIZER = "word_bpe_49k.json"
END_ID = 2

# --- the codes ------------------------------------------------------------------------------------


def encode_levels(ids: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Chunks, bitmap and rank directory of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        levels.append(
            {
                "chunks": (rest & 255).astype(np.uint8),
                "bitmap": np.packbits(more, bitorder="little"),
                "ranks": np.concatenate([[0], np.cumsum(ones)]).astype(np.int64),
            }
        )
        if not more.any():
            return levels
        rest = rest[more] >> 8


class Codes:
    """Reading ids from their levels."""

    def __init__(self, levels: list[dict[str, np.ndarray]]):
        self.levels = levels

    def __len__(self) -> int:
        return len(self.levels[0]["chunks"])

    def _rank(self, level: dict[str, np.ndarray], place: int) -> int:
        """The number of ones before a place."""
        block = place // BLOCK
        first = block * BLOCK // 8
        bits = np.unpackbits(level["bitmap"][first : (place + 7) // 8], bitorder="little")
        return int(level["ranks"][block]) + int(bits[: place - block * BLOCK].sum())

    def __getitem__(self, place: int) -> int:
        value, shift = 0, 0
        for level in self.levels:
            value |= int(level["chunks"][place]) << shift
            if not level["bitmap"][place >> 3] >> (place & 7) & 1:
                return value
            place, shift = self._rank(level, place), shift + 8
        raise ValueError("an id goes on behind the last level")

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to before ``stop``."""
        result = np.zeros(stop - start, np.uint32)
        at, shift = np.arange(stop - start), np.uint32(0)
        for level in self.levels:
            if start >= stop:
                break
            result[at] |= level["chunks"][start:stop].astype(np.uint32) << shift
            bits = np.unpackbits(level["bitmap"][start // 8 : (stop + 7) // 8], bitorder="little")
            at = at[bits[start % 8 : start % 8 + stop - start].astype(bool)]
            start, stop = self._rank(level, start), self._rank(level, start) + len(at)
            shift += np.uint32(8)
        return result


def shard_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    arrays = {
        "doc_ids": np.array([d if d is not None else 0 for d in doc_ids], np.int64),
        "doc_nulls": np.array([d is None for d in doc_ids], np.uint8),
        "doc_starts": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
    }
    levels = encode_levels(ids)
    for k, level in enumerate(levels):
        arrays |= {f"{name}_{k}": a for name, a in level.items()}
    places, at = {}, 0
    for name, a in arrays.items():
        places[name] = [at, a.dtype.str, len(a)]
        at += a.nbytes
    header = json.dumps({"levels": len(levels), "arrays": places}).encode()
    out = io.BytesIO()
    out.write(MAGIC + len(header).to_bytes(8, "little") + header)
    for a in arrays.values():
        out.write(a.tobytes())
    return out.getvalue()


class Shard:
    """A shard read from its bytes (or a memory map of them)."""

    def __init__(self, data):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        length = int.from_bytes(data[8:16], "little")
        header = json.loads(bytes(data[16 : 16 + length]))
        base = 16 + length
        a = {
            name: np.frombuffer(data, np.dtype(kind), n, base + at) for name, (at, kind, n) in header["arrays"].items()
        }
        self.doc_ids, self.doc_nulls, self.starts = a["doc_ids"], a["doc_nulls"], a["doc_starts"]
        names = "chunks", "bitmap", "ranks"
        self.codes = Codes([{n: a[f"{n}_{k}"] for n in names} for k in range(header["levels"])])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document id, start in the shard and ids of each document."""
        ids, starts = self.codes.range(0, len(self.codes)), self.starts.tolist()
        for doc, null, start, stop in zip(self.doc_ids.tolist(), self.doc_nulls.tolist(), starts, starts[1:]):
            yield None if null else doc, start, ids[start:stop]


# --- encoding ---------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts from those of their words, for tokenizers that ignore case in words of ASCII alone
    and never join across the six ASCII blanks.

    Arrow splits all texts of a batch and numbers their distinct words; only these are looked up. New
    ones are encoded many at once, a blank between them, and told apart by their offsets. ASCII marks
    behind a letter are pieces of their own in such tokenizers, so they are encoded apart from the word.
    """

    MARKS = ".,!?;:%$#&*)"

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        # Two generations of a bounded cache: words of the older one come back when they are met again.
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind another, and the number of ids of each."""
        lists = pc.ascii_split_whitespace(self._lowered(texts))
        words = lists.flatten().dictionary_encode()
        blob, sizes = self._distinct(self._lowered(words.dictionary))
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        which = words.indices.to_numpy(zero_copy_only=False)
        counts = sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(starts[which] - ends[:-1].astype(np.int32), counts)
        places += np.arange(len(places), dtype=np.int32)
        at = ends[lists.offsets.to_numpy(zero_copy_only=False) - lists.offsets[0].as_py()]
        return blob[places], np.diff(at)

    @staticmethod
    def _lowered(texts: pa.Array) -> pa.Array:
        """Texts that are ASCII throughout in lower case. Others stay as they are, since a capital and a
        mark behind it may compose differently from the small letter; so do special tokens, which depend
        on case and begin with "<|"."""
        fixed = pc.or_(pc.invert(pc.string_is_ascii(texts)), pc.match_substring(texts, "<|"))
        return pc.if_else(fixed, texts, pc.ascii_lower(texts))

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one behind another, and the number of ids of each."""
        stems = pc.ascii_rtrim(words, characters=self.MARKS)
        # The last byte tells a lower-case letter of ASCII at once; other stems stay whole words unless
        # they end with a letter in lower case.
        ends = np.frombuffer(stems.buffers()[1], np.int32, len(stems) + 1, stems.offset * 4)[1:]
        data = np.frombuffer(stems.buffers()[2] or b"", np.uint8)
        sizes = pc.binary_length(stems).to_numpy(zero_copy_only=False)
        cut = pc.binary_length(words).to_numpy(zero_copy_only=False) - sizes
        last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(stems), np.uint8)
        plain = (sizes > 0) & (last >= 97) & (last <= 122)
        whole = np.flatnonzero((cut > 0) & ~plain)
        keep = [k for k, stem in zip(whole.tolist(), stems.take(whole).to_pylist()) if not stem or not stem[-1].lower()[-1].isalpha()]
        if keep:
            mask = np.zeros(len(words), bool)
            mask[keep] = True
            stems = pc.if_else(pa.array(mask), words, stems)
            cut = np.where(mask, 0, cut)
        units = stems.dictionary_encode()
        ids = self._looked_up(units.dictionary.cast(pa.binary()).to_pylist())
        marked = np.flatnonzero(cut)
        tails = [w[-n:] for w, n in zip(words.take(marked).cast(pa.binary()).to_pylist(), cut[marked].tolist())]
        known = dict(zip(distinct := list(set(tails)), self._looked_up(distinct)))
        result = list(map(ids.__getitem__, units.indices.to_pylist()))
        for k, tail in zip(marked.tolist(), tails):
            result[k] += known[tail]
        return np.frombuffer(b"".join(result), "<u4"), np.fromiter(map(len, result), np.int32, len(result)) // 4

    def _together(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        data = np.array(found.ids, "<u4").tobytes()
        cuts = (4 * np.searchsorted([a for a, _ in found.offsets], starts)).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _looked_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; new ones are encoded, and kept if they are short."""
        if len(self.known) > CACHED_PIECES:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        ids = list(map(known.get, words))
        gaps = [k for k, x in enumerate(ids) if x is None]
        for k in gaps:
            ids[k] = old.get(words[k])
        new = [k for k in gaps if ids[k] is None]
        for j in range(0, len(new), 200):
            part = new[j : j + 200]
            for k, found in zip(part, self._together([words[k] for k in part])):
                ids[k] = found
        known.update((words[k], ids[k]) for k in gaps if len(words[k]) <= CACHED_LENGTH)
        return ids


@lru_cache(maxsize=2)
def word_encoder(name: str) -> WordEncoder:
    return WordEncoder(name)


# --- files --------------------------------------------------------------------------------------------


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def write_shards(
    rows: DataFrame, folder: str, name: str = DEFAULT_TOKENIZER, end_id: int = END_ID, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Encode rows (id, text), an end id behind each, and write them in their order; the manifest has a
    row for each shard."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = word_encoder(name)
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        docs, counts, parts, seq, held = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            file = f"shard-{part:06d}-{seq:06d}.dac"
            partial = f"{root}/.{file}.{uuid.uuid4().hex}"
            with fs.open_output_stream(partial) as out:
                out.write(shard_bytes(docs, counts, np.concatenate(parts)))
            fs.move(partial, f"{root}/{file}")
            row = {"part": [part], "seq": [seq], "file": [file], "n_docs": [len(docs)], "n_ids": [held]}
            docs.clear(), counts.clear(), parts.clear()
            seq, held = seq + 1, 0
            return pa.RecordBatch.from_pydict(row, schema)

        for ids_of, texts in _gathered(batches, ENCODED_BYTES):
            ids, sizes = encoder.encode(texts)
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
            # Ids of most vocabularies fit 16 bits; what is held takes half the room then.
            parts.append(ids.astype(np.uint16) if ids.max() < 65536 else ids)
            docs += ids_of.to_pylist()
            counts += (sizes + 1).tolist()
            held += len(ids)
            if held >= shard_ids:
                yield flush()
        if docs:
            yield flush()

    schema = pa.schema(
        [("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
    )
    ddl = "part int, seq int, file string, n_docs bigint, n_ids bigint"
    manifest = rows.select("id", "text").mapInArrow(write, ddl)
    return materialize(manifest, "token-manifest")


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of batches put together up to ``size`` bytes, as larger ones repeat more words."""
    held, total = [], 0
    for batch in batches:
        if held and total + batch.nbytes > size:
            yield _joined(held)
            held, total = [], 0
        held.append(batch)
        total += batch.nbytes
    if held and sum(b.num_rows for b in held):
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    return tuple(pa.concat_arrays([b.column(k) for b in batches]) for k in range(2))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: id, start among all ids, number of ids, their CRC-32."""
    schema = T.StructType.fromDDL("id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as source:
                    shard = Shard(source.read_buffer())
                rows = [(d, base + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in shard.documents()]
                columns = list(zip(*rows))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=schema.names)

    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    placed = materialize(placed, "token-places")
    n = max(1, min(placed.count(), 10_000))
    return placed.repartition(n, "file").mapInArrow(read, schema)


def write_documents(
    df: DataFrame, folder: str, id_: str = "doc_id", text: str = "text", name: str = DEFAULT_TOKENIZER
) -> DataFrame:
    """Encode all texts and write them in ascending order of id; returns the manifest."""
    spark = df.sparkSession
    python_ready(spark)
    # Texts are ranged before they are encoded, as finding the ranges reads all rows once more.
    rows = df.select(quoted(id_).alias("id"), text_of(text).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = F.col("id").asc_nulls_first()
    ordered = rows.repartitionByRange(n, ids).sortWithinPartitions(ids, "text")
    return write_shards(ordered, folder, name)


def op9_token_files(spark, folder: str) -> DataFrame:
    shards = scratch_path(spark, "token-files")
    manifest = write_documents(documents(spark, folder), shards)
    return read_shards(manifest, shards).withColumnRenamed("id", "doc_id")
