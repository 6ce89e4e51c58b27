"""The document operators' queries, and SQL where SQL can express them."""

from __future__ import annotations

from graphloom.llm.brown_lm import op1_brown_lm
from graphloom.llm.count_rtree import op5_count_rtree
from graphloom.llm.fair_queue import op12_fair_queue
from graphloom.llm.language_mixture import op4_language_mixture
from graphloom.llm.line_crf import op10_line_crf
from graphloom.llm.line_runs import op7_line_runs
from graphloom.llm.prefix_trie import op11_prefix_trie
from graphloom.llm.qgram_decontam import op9_qgram_decontam
from graphloom.llm.quality_cnn import op2_quality_cnn
from graphloom.llm.repeat_suffixes import op6_repeat_suffixes
from graphloom.llm.spelling_trie import op13_spelling_trie
from graphloom.llm.sql import ORACLE_SQL
from graphloom.llm.trie_bpe import op8_trie_bpe
from graphloom.llm.weighted_tree import op3_weighted_hash_tree

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_brown_lm": op1_brown_lm,
    "op2_quality_cnn": op2_quality_cnn,
    "op3_weighted_hash_tree": op3_weighted_hash_tree,
    "op4_language_mixture": op4_language_mixture,
    "op5_count_rtree": op5_count_rtree,
    "op6_repeat_suffixes": op6_repeat_suffixes,
    "op7_line_runs": op7_line_runs,
    "op8_trie_bpe": op8_trie_bpe,
    "op9_qgram_decontam": op9_qgram_decontam,
    "op10_line_crf": op10_line_crf,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fair_queue": op12_fair_queue,
    "op13_spelling_trie": op13_spelling_trie,
}
