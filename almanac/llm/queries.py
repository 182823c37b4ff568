"""The queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from almanac.llm import chaining, clusters, decontaminate, html_text, lattice, licenses, mixing, ngram_join, packing, quality_rules, suffix_dedup, webp, whitening


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
        "op3_webp_media": webp.op3_webp_media,
        "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
        "op5_lattice_scoring": lattice.op5_lattice_scoring,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_harmonic_packing": packing.op7_harmonic_packing,
        "op8_substring_chaining": chaining.op8_substring_chaining,
        "op9_source_mixing": mixing.op9_source_mixing,
        "op10_html_extraction": html_text.op10_html_extraction,
        "op11_winnowing_decontamination": decontaminate.op11_winnowing_decontamination,
        "op12_interval_clustering": clusters.op12_interval_clustering,
        "op13_jacobi_whitening": whitening.op13_jacobi_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": ngram_join.ORACLE,
        "op6_license_scan": licenses.ORACLE,
        "op9_source_mixing": mixing.ORACLE,
        "op11_winnowing_decontamination": decontaminate.ORACLE,
        "op12_interval_clustering": clusters.ORACLE,
    }
