"""The registered queries of this package: name -> (job, SQL or None)."""

from __future__ import annotations

from tidemark.llm import (
    byte_bpe,
    curve_shards,
    exact_dedup,
    language_codes,
    merkle,
    mixing,
    personal_data,
    quality_rules,
    recurrent_lm,
    secret_scan,
    simhash,
    token_files,
    turn_trie,
)

# The others are tested against brute force: SQL lacks their hashes, tokenizers and models.
QUERIES = {
    "op1_byte_bpe": (byte_bpe.op1_byte_bpe, None),
    "op2_quality_rules": (quality_rules.op2_quality_rules, quality_rules.SQL),
    "op3_exact_dedup": (exact_dedup.op3_exact_dedup, exact_dedup.SQL),
    "op4_simhash": (simhash.op4_simhash, None),
    "op5_recurrent_lm": (recurrent_lm.op5_recurrent_lm, None),
    "op6_mixing": (mixing.op6_mixing, mixing.SQL),
    "op7_secret_scan": (secret_scan.op7_secret_scan, None),
    "op8_personal_data": (personal_data.op8_personal_data, None),
    "op9_token_files": (token_files.op9_token_files, None),
    "op10_language_codes": (language_codes.op10_language_codes, None),
    "op11_merkle": (merkle.op11_merkle, merkle.SQL),
    "op12_curve_shards": (curve_shards.op12_curve_shards, curve_shards.SQL),
    "op13_turn_trie": (turn_trie.op13_turn_trie, turn_trie.SQL),
}
