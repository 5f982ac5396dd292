"""The queries of the corpus operators and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from newsfold.llm import byte_bpe, exact_dedup, filter_audit, html_text, license_scan, packing, quality_model, quality_rules, sharding, simhash, spelling, substring_dedup, token_counts


def queries():
    import corpus_pipeline

    return {
        "op1_exact_dedup": exact_dedup.op1,
        "op2_token_counts": token_counts.op2,
        "op3_simhash_near_dedup": simhash.op3,
        "op4_quality_model": quality_model.op4,
        "op5_byte_bpe": byte_bpe.op5,
        "op6_quality_rules": quality_rules.op6,
        "op7_html_text": html_text.op7,
        "op8_substring_dedup": substring_dedup.op8,
        "op9_packing": packing.op9,
        "op10_sharding": sharding.op10,
        "op11_spelling_variants": spelling.op11,
        "op12_license_scan": license_scan.op12,
        "op13_filter_audit": filter_audit.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op6_quality_rules": quality_rules.OP6_SQL,
        "op11_spelling_variants": spelling.OP11_SQL,
        "op12_license_scan": license_scan.OP12_SQL,
        "op13_filter_audit": filter_audit.OP13_SQL,
    }
