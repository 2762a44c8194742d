import random
import zlib

import numpy as np
import pytest

from tidemark.llm import token_files as t
from tidemark.session import scratch_path

LETTERS = ["a", "!", "e.", "a$$$", "B", "é", "é", "́", " ", "  ", "\t", " ", "\x1c", "Σ", "ς", "İ", "İ!", "ﬁ", "漢", "1",
           "²", "'s", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "‍", "👍", "Ⅷ", "　", "\x0b", "\x85", " "]


@pytest.fixture(scope="module")
def library():
    return t.word_encoder(t.DEFAULT_TOKENIZER).tokenizer


def test_codes_give_any_id():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 2000):
        for top in (10, 300, 70000, 2**32 - 1):
            ids = rng.integers(0, top, n).astype(np.uint32)
            codes = t.Codes(t.encode_levels(ids))
            assert len(codes) == n
            assert all(codes[int(k)] == ids[k] for k in rng.integers(0, max(n, 1), 40 * (n > 0)))
            for a, b in np.sort(rng.integers(0, n + 1, (20, 2))):
                assert codes.range(int(a), int(b)).tolist() == ids[a:b].tolist()


def test_shard_round_trip():
    docs = [(None, [2]), (-5, [1, 2, 70000]), (7, []), (9, list(range(1000)))]
    ids = np.array([x for _, own in docs for x in own], np.uint32)
    shard = t.Shard(t.shard_bytes([d for d, _ in docs], [len(own) for _, own in docs], ids))
    assert [(d, own.tolist()) for d, _, own in shard.documents()] == docs
    with pytest.raises(ValueError):
        t.Shard(b"something else")


def test_words_encode_like_whole_texts(library):
    rng = random.Random(1)
    encoder = t.word_encoder(t.DEFAULT_TOKENIZER)
    for _ in range(300):
        texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(10)]
        ids, sizes = encoder.encode(t.pa.array(["x", *texts])[1:])
        parts = [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])]
        assert parts == [library.encode(x, add_special_tokens=False).ids for x in texts], texts


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(t, "CACHED_PIECES", 3)
    monkeypatch.setattr(t, "CACHED_LENGTH", 4)
    encoder, texts = t.WordEncoder(t.DEFAULT_TOKENIZER), ["some words, some more", "words and longerwords!", "some"] * 3
    for _ in range(3):
        ids, sizes = encoder.encode(t.pa.array(texts))
        assert ids.tolist() == [i for x in texts for i in library.encode(x, add_special_tokens=False).ids]


@pytest.mark.parametrize("shard_ids", [8_000_000, 500])
def test_files(spark, edge, library, shard_ids, monkeypatch):
    df, rows, empty = edge
    monkeypatch.setattr(t, "ENCODED_BYTES", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    folder = scratch_path(spark, "tokens")
    ids = t.F.col("id").asc_nulls_first()
    ordered = df.selectExpr("doc_id AS id", "coalesce(text, '') AS text").repartitionByRange(3, ids).sortWithinPartitions(ids)
    manifest = t.write_shards(ordered, folder, shard_ids=shard_ids)
    found = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in t.read_shards(manifest, folder).collect()}
    at = 0
    for id_, text in sorted(rows):
        own = np.array([*library.encode(text or "", add_special_tokens=False).ids, t.END_ID], "<u4")
        assert found[id_] == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert manifest.count() >= (3 if shard_ids > 500 else 6)


def test_null_ids_repeats_and_no_rows(spark, edge):
    folder = scratch_path(spark, "tokens")
    df = spark.createDataFrame([(5, "a b"), (None, "x"), (5, None), (5, "a b")], "doc_id bigint, text string")
    found = t.read_shards(t.write_documents(df, folder), folder).collect()
    assert sorted((r.start, str(r.id), r.n_tokens) for r in found) == [(0, "None", 2), (2, "5", 1), (3, "5", 3), (6, "5", 3)]
    folder = scratch_path(spark, "tokens")
    assert t.read_shards(t.write_documents(edge[2], folder), folder).count() == 0


def test_capitals_before_combining_marks_stay(library):
    marks = [chr(k) for k in range(0x300, 0x370)]
    words = [f"{chr(c)}{m}{tail}" for c in range(65, 91) for m in marks for tail in ("", "i", "S!")]
    texts = words + [f"The {w} And THE {w.lower()}" for w in words[::7]]
    ids, sizes = t.word_encoder(t.DEFAULT_TOKENIZER).encode(t.pa.array(texts))
    parts = [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])]
    assert parts == [library.encode(x, add_special_tokens=False).ids for x in texts]
