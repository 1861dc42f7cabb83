"""The operators' queries over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, jaccard, licenses, lines, mixing, packing, rules, secrets, sharding, spans, turns, urls


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_packing": packing.op3_packing,
        "op4_sentence_spans": spans.op4_sentence_spans,
        "op5_jaccard_join": jaccard.op5_jaccard_join,
        "op6_hypergeometric_shards": sharding.op6_hypergeometric_shards,
        "op7_quality_rules": rules.op7_quality_rules,
        "op8_url_filters": urls.op8_url_filters,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_secret_scan": secrets.op10_secret_scan,
        "op11_source_mixing": mixing.op11_source_mixing,
        "op12_conversation_repair": turns.op12_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": lines.SQL,
        "op5_jaccard_join": jaccard.SQL,
        "op8_url_filters": urls.SQL,
        "op11_source_mixing": mixing.SQL,
        "op12_conversation_repair": turns.SQL,
    }
