"""Registered queries of this package and their SQL."""

from __future__ import annotations

from shopfloor.llm import (
    automata, decontamination, extraction, grid_order, jaccard, licences, mixing, periodic_runs, quality_model, quality_rules, sharding, signatures, suffixes,
)

QUERIES = {
    "op1_extract": extraction.op1_extract,
    "op2_license_scan": licences.op2_license_scan,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_shard": sharding.op4_shard,
    "op5_substring_dedup": automata.op5_substring_dedup,
    "op6_quality_model": quality_model.op6_quality_model,
    "op7_mix": mixing.op7_mix,
    "op8_decontaminate": decontamination.op8_decontaminate,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_ranked_search": signatures.op12_ranked_search,
    "op13_embedding_dedup": grid_order.op13_embedding_dedup,
}
SQL = {
    "op2_license_scan": licences.op2_sql(),
    "op5_substring_dedup": automata.OP5_SQL,
    "op7_mix": mixing.OP7_SQL,
    "op8_decontaminate": decontamination.OP8_SQL,
    "op9_jaccard_join": jaccard.OP9_SQL,
    "op12_ranked_search": signatures.OP12_SQL,
    "op13_embedding_dedup": grid_order.OP13_SQL,
}
