import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm import brute
from tidemark.llm import byte_bpe as b


@pytest.fixture(scope="module")
def library():
    ranks = b.read_ranks(public_tokenizers.path(b.DEFAULT_RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strings(n, seed=0):
    rng = random.Random(seed)
    letters = "ab \n\t'stvelmd1é漢字  .,! ́\x1c👍"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_equal_to_the_library(library):
    v = b.vocabulary()
    for text in [*strings(2000), "a" * 20000, "ab" * 9999, " " * 300, "<|endoftext|>"]:
        ids = np.frombuffer(v.encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert v.decode(v.encode(text)) == text.encode()


def test_every_token_encodes_to_itself():
    v = b.vocabulary()
    assert all(v.whole(t) for t in random.Random(2).sample(sorted(v.bytes_of), 3000))


def test_appends_and_edits_are_exact(library):
    v, rng, texts = b.vocabulary(), random.Random(3), strings(400, 4)
    for text in texts:
        kept = b.EncodedText(v, text)
        for _ in range(4):
            start = rng.randint(0, len(kept.text))
            kept.replace(start, min(len(kept.text), start + rng.randint(0, 8)), rng.choice(texts)[: rng.randint(0, 12)])
            kept.append(rng.choice(["l", "ve", " ", "s ", "x", "é", ""]))
            assert kept.ids() == library.encode_ordinary(kept.text)


def test_small_caches_change_nothing(library):
    v = b.Vocabulary(library._mergeable_ranks, public_tokenizers.PATTERN)
    v.pieces.limit = 5
    text = " ".join(strings(50, 6))
    assert np.frombuffer(v.encode(text) + v.encode(text), "<u4").tolist() == library.encode_ordinary(text) * 2


def test_documents(edge, library):
    df, rows, empty = edge
    out = b.encode_documents(df)
    assert out.columns == [*df.columns, "ids_"]
    done = b.decode_documents(out, "ids_").collect()
    assert {r.doc_id: np.frombuffer(r.ids_, "<u4").tolist() for r in done} == {
        i: library.encode_ordinary(t or "") for i, t in rows
    }
    assert {r.doc_id: bytes(r.decoded) for r in done} == {i: (t or "").encode() for i, t in rows}
    assert b.encode_documents(empty).count() == 0
    assert b.encode_documents(df.union(df)).count() == 2 * len(rows)


def test_encoding_runs_once(edge):
    plan = b.decode_documents(b.encode_documents(edge[0]), "ids_")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("encode(coalesce") == 1
    assert brute.sha(b"") == brute.sha("")
