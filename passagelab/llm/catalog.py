"""Registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from .decontamination import OP3_SQL, op3_decontamination
from .embeddings import OP7_SQL, op7_embedding_dedup
from .minhash import OP5_SQL, op5_minhash_dedup
from .sentencepieces import op6_sentencepiece
from .sharding import op10_sharding
from .toxicity import op8_toxicity
from .substrings import OP4_SQL, op4_substring_dedup
from .suffixes import OP9_SQL, op9_suffix_array_dedup
from .tokencount import op2_token_counts
from .warc import OP1_SQL, op1_warc


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_token_counts": op2_token_counts,
        "op3_decontamination": op3_decontamination,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_sharding": op10_sharding,
    }


def oracles() -> dict:
    return {
        "op1_warc": OP1_SQL,
        "op3_decontamination": OP3_SQL,
        "op4_substring_dedup": OP4_SQL,
        "op5_minhash_dedup": OP5_SQL,
        "op7_embedding_dedup": OP7_SQL,
        "op9_suffix_array_dedup": OP9_SQL,
    }
