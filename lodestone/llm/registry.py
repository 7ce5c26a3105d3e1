"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, fingerprint, html, mixing, periodic, quality, repair, rulefit, simhash, toxicity, warc, wavelet


def queries() -> dict:
    return {
        "op1_simhash_gray_index": simhash.query,
        "op2_prefix_fingerprints": fingerprint.query,
        "op3_warc_store": warc.query,
        "op4_quality_rules": quality.query,
        "op5_toxicity_lexicon": toxicity.query,
        "op6_wrapper_html": html.query,
        "op7_wavelet_tokens": wavelet.query,
        "op8_byte_bpe": bpe.query,
        "op9_soft_mixing": mixing.query,
        "op10_preference_chat": chat.query,
        "op11_structure_repair": repair.query,
        "op12_rule_ensemble": rulefit.query,
        "op13_periodic_runs": periodic.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_store": warc.ORACLE_SQL,
        "op4_quality_rules": quality.ORACLE_SQL,
        "op10_preference_chat": chat.ORACLE_SQL,
    }
