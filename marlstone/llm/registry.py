"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from corpus_pipeline import run
from marlstone.llm import lexical, negatives
from marlstone.llm.decontam import op9_bm25_block_max
from marlstone.llm.lines import op10_fuzzy_lines
from marlstone.llm.mixing import op2_pivotal_mix
from marlstone.llm.pii import op1_feistel_pseudonyms
from marlstone.llm.quality import op4_tokeniser_fertility
from marlstone.llm.secretscan import op7_character_network
from marlstone.llm.sharding import op6_hypergeometric_shards
from marlstone.llm.simhash import op5_simhash_golay
from marlstone.llm.substrings import op3_super_kmers
from marlstone.llm.tokenbin import op8_perfect_hash_shards
from marlstone.llm.tokencount import op13_rank_synchronous

QUERIES = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_pivotal_mix": op2_pivotal_mix,
    "op3_super_kmers": op3_super_kmers,
    "op4_tokeniser_fertility": op4_tokeniser_fertility,
    "op5_simhash_golay": op5_simhash_golay,
    "op6_hypergeometric_shards": op6_hypergeometric_shards,
    "op7_character_network": op7_character_network,
    "op8_perfect_hash_shards": op8_perfect_hash_shards,
    "op9_bm25_block_max": op9_bm25_block_max,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op11_ball_tree": negatives.op11_ball_tree,
    "op12_tput": lexical.op12_tput,
    "op13_rank_synchronous": op13_rank_synchronous,
    "pipeline": run,
}

ORACLES: dict[str, str] = {"op11_ball_tree": negatives.ORACLE, "op12_tput": lexical.ORACLE}
