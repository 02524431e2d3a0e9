"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from sluice.llm import bpe, chat, decontaminate, lines, quality, rans, simhash, suffixes, toxicity, warc

QUERIES = {
    "op1_bpe_transducer": bpe.op1_bpe_transducer,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_fertility_rules": quality.op3_fertility_rules,
    "op4_preference_pairs": chat.op4_preference_pairs,
    "op5_toxic_segments": toxicity.op5_toxic_segments,
    "op6_rans_ids": rans.op6_rans_ids,
    "op7_fuzzy_lines": lines.op7_fuzzy_lines,
    "op8_warc_shards": warc.op8_warc_shards,
    "op9_bm25_decontamination": decontaminate.op9_bm25_decontamination,
    "op10_simhash_vptree": simhash.op10_simhash_vptree,
}

ORACLE_SQL = {
    "op4_preference_pairs": chat.ORACLE_SQL,
    "op8_warc_shards": warc.ORACLE_SQL,
}
