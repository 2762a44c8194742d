"""The registered queries on the smallest data set, against brute force, and the pipeline as a whole."""

import base64
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from tidemark.llm import byte_bpe, quality_rules, token_files
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


@pytest.fixture(scope="module")
def result(spark):
    held = {}

    def run(name):
        if name not in held:
            held[name] = {r.doc_id: r for r in QUERIES[name][0](spark, FOLDER).collect()}
        return held[name]

    return run


@pytest.fixture(scope="module")
def bpe():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.DEFAULT_RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def crc(id_):
    return zlib.crc32(str(id_).encode())


def test_registered():
    assert set(QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_op1(docs, result, bpe):
    for d in docs:
        ids, r = bpe.encode_ordinary(d.text), result("op1_byte_bpe")[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == brute.sha(d.text)


def test_op2(docs, result):
    for d in docs:
        wanted = brute.quality(d.text, quality_rules.LineRules())
        assert {k: result("op2_quality_rules")[d.doc_id][k] for k in wanted} == wanted


def test_op2_keeps_good_documents(spark, result):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    rows = result("op2_quality_rules")
    good = [rows[x.doc_id].kept for x in labels if x.quality == 1 and not rows[x.doc_id].base_failed]
    bad = [rows[x.doc_id].kept for x in labels if x.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_op3(docs, result):
    wanted = brute.exact_groups([(d.doc_id, d.text) for d in docs])
    assert {i: (r.keep_id, r.group_size) for i, r in result("op3_exact_dedup").items()} == wanted


def test_op4(docs, result):
    rows = result("op4_simhash")
    assert {i: r.component_id for i, r in rows.items()} == brute.components([(d.doc_id, d.text) for d in docs])
    assert all(rows[d.doc_id].fingerprint == f"{brute.fingerprint(d.text):016x}" for d in docs)


def test_op5(docs, result):
    rows = result("op5_recurrent_lm")
    n, wanted = brute.unigram_scores([(d.doc_id, d.text) for d in docs], lambda i: crc(i) % 5 == 1)
    for i, (tokens, known, base) in wanted.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, crc(i) % 5 == 1)
        assert r.base_score == pytest.approx(base)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op6(docs, result):
    rows, sizes, source = result("op6_mixing"), defaultdict(int), {d.doc_id: d.source for d in docs}
    for d in docs:
        sizes[d.source] += len(d.text.split())
    wanted = brute.water_fill(sizes)
    taken = defaultdict(int)
    for r in rows.values():
        s = source[r.doc_id]
        assert r.target == pytest.approx(wanted[s]) and r.source_size == sizes[s]
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
    longest = max(r.size for r in rows.values())
    assert all(abs(taken[s] - wanted[s]) <= longest for s in sizes)


def test_op7(docs, result):
    for d in docs:
        base, r = brute.secret_spans(d.text), result("op7_secret_scan")[d.doc_id]
        assert r.base_sha256 == brute.sha(",".join(base))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
        assert set(base) <= set(r.spans.split(",")) | set()


def test_op8(docs, result):
    for d in docs:
        base, r = brute.personal_spans(d.text), result("op8_personal_data")[d.doc_id]
        assert r.base_sha256 == brute.sha(",".join(base))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            sum(b.startswith(k) for b in base) for k in ("email", "ip", "card", "phone")
        ]
        assert set(base) <= set(r.spans.split(","))


def test_op9(docs, result):
    library, at = token_files.word_encoder(token_files.DEFAULT_TOKENIZER).tokenizer, 0
    for d in sorted(docs, key=lambda d: d.doc_id):
        ids = np.array([*library.encode(d.text, add_special_tokens=False).ids, 2], "<u4")
        r = result("op9_token_files")[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op10(docs, result):
    rows = result("op10_language_codes")
    assert all(rows[d.doc_id].held_out == (crc(d.doc_id) % 4 == 2) for d in docs)
    held = [rows[d.doc_id].lang_pred == d.lang for d in docs if rows[d.doc_id].held_out]
    assert np.mean(held) > 0.95


def test_op11(docs, result):
    wanted = brute.merkle([tuple(d) for d in docs], docs[0].__fields__, lambda d: crc(d["doc_id"]) % 3 == 0)
    for i, r in result("op11_merkle").items():
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == wanted[i]


def test_op12(docs, result):
    rows = result("op12_curve_shards")
    assert {r.law for r in rows.values()} == {"rows"} and {r.shard for r in rows.values()} == set(range(40))
    slots = defaultdict(list)
    for d in docs:
        r = rows[d.doc_id]
        assert r.size == len(d.text.encode()) + 16 and r.text_crc32 == zlib.crc32(d.text.encode())
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} <= {len(docs) // 40, -(-len(docs) // 40)}


def test_op13(spark):
    talks = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    found = QUERIES["op13_turn_trie"][0](spark, FOLDER).collect()
    assert sorted(tuple(r) for r in found if r.depth) == sorted(r for r in brute.trie([tuple(r) for r in talks]) if r[1])
    assert sum(r.depth == 0 for r in found) == 1


def test_native_plans_hold_no_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    native = dict(corpus_pipeline.STAGES)
    plans = [QUERIES[n][0](spark, FOLDER) for n in ("op2_quality_rules", "op3_exact_dedup", "op6_mixing", "op12_curve_shards")]
    plans += [native[n](spark, docs, FOLDER) for n in ("quality rules", "exact dedup", "mixing sources to target weights")]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_pipeline(spark, docs, bpe):
    rules = quality_rules.LineRules()
    good = [
        Row(doc_id=d.doc_id, source=d.source, text=brute.cleaned(d.text, rules))
        for d in docs if brute.quality(d.text, rules)["kept"]
    ]
    keep = {k for k, _ in brute.exact_groups([(d.doc_id, d.text) for d in good]).values()}
    once = [d for d in good if d.doc_id in keep]
    near = brute.components([(d.doc_id, d.text) for d in once])
    left = {d.doc_id: d for d in once if near[d.doc_id] == d.doc_id}

    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} <= set(left)
    for r in rows:
        ids = np.frombuffer(base64.b64decode(r.ids_base64), "<u4").tolist()
        assert ids == bpe.encode_ordinary(left[r.doc_id].text) and r.n_tokens == len(ids)
    times = Counter(r.doc_id for r in rows)
    size = {i: len(d.text.split()) for i, d in left.items()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, d in left.items():
        sizes[d.source] += size[i]
        taken[d.source] += size[i] * times[i]
    wanted, longest = brute.water_fill(sizes), max(size.values())
    assert max(times.values()) <= 3
    assert all(abs(taken[s] - wanted[s]) <= longest for s in sizes)
