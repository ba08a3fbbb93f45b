"""The training-data queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import brown, decontaminate, edit_counts, exact_dedup, hard_negatives, kneser_ney, packing, sharding, simhash, suffix_dedup, token_store, vector_codes, warc_index

QUERIES = {
    "op1_warc_index": warc_index.op1_warc_index,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_edit_counts": edit_counts.op3_edit_counts,
    "op4_brown_lm": brown.op4_brown_lm,
    "op5_packing": packing.op5_packing,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality": kneser_ney.op9_quality,
    "op10_simhash": simhash.op10_simhash,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_token_store": token_store.op12_token_store,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
SQL = {"op2_exact_dedup": exact_dedup.SQL, "op8_sharding": sharding.SQL, "op11_hard_negatives": hard_negatives.SQL, "op13_vector_codes": vector_codes.SQL}
