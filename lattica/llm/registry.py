"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat_perspectives import OP5_SQL, op5_chat_perspectives
from .cost_packing import op4_cost_packing
from .credential_linking import OP12_SQL, op12_credential_linking
from .infilling import OP11_SQL, op11_automaton_infilling
from .line_dedup import OP6_SQL, op6_line_dedup
from .pivot_index import OP3_SQL, op3_pivot_permutations
from .rule_quality import op2_rule_ensemble
from .simhash_vptree import op1_simhash_vptree
from .slot_sharding import op7_slot_sharding
from .source_mixing import OP10_SQL, op10_source_mixing
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .telephony_audio import op9_telephony_audio
from .token_alignment import op13_postings_alignment

QUERIES = {
    "op1_simhash_vptree": op1_simhash_vptree,
    "op2_rule_ensemble": op2_rule_ensemble,
    "op3_pivot_permutations": op3_pivot_permutations,
    "op4_cost_packing": op4_cost_packing,
    "op5_chat_perspectives": op5_chat_perspectives,
    "op6_line_dedup": op6_line_dedup,
    "op7_slot_sharding": op7_slot_sharding,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_telephony_audio": op9_telephony_audio,
    "op10_source_mixing": op10_source_mixing,
    "op11_automaton_infilling": op11_automaton_infilling,
    "op12_credential_linking": op12_credential_linking,
    "op13_postings_alignment": op13_postings_alignment,
}

ORACLES = {
    "op3_pivot_permutations": OP3_SQL,
    "op5_chat_perspectives": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op10_source_mixing": OP10_SQL,
    "op11_automaton_infilling": OP11_SQL,
    "op12_credential_linking": OP12_SQL,
}
