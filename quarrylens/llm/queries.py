"""Queries over the operators of this subpackage, and SQL where whole tables can be expressed in it."""

from __future__ import annotations

from quarrylens.llm import credentials, docpairs, leakage, natural, personal, provenance, syntax, tokenize_corpus


def queries():
    return {
        "p1_found": docpairs.p1_found,
        "p1_pairs": docpairs.p1_pairs,
        "p2_found": credentials.p2_found,
        "p2_redacted_configs": credentials.p2_redacted_configs,
        "p2_redacted_literals": credentials.p2_redacted_literals,
        "p2_redacted_sources": credentials.p2_redacted_sources,
        "p3_found": natural.p3_found,
        "p3_shares": natural.p3_shares,
        "p4_found": syntax.p4_found,
        "p4_rates": syntax.p4_rates,
        "p5_found": provenance.p5_found,
        "p5_reasons": provenance.p5_reasons,
        "p5_hand_written": provenance.p5_hand_written,
        "p7_ids": tokenize_corpus.p7_ids,
        "p7_token_counts": tokenize_corpus.p7_token_counts,
        "p8_found": leakage.p8_found,
        "p9_found": personal.p9_found,
        "p9_redacted": personal.p9_redacted,
        "p8_leaks_per_item": leakage.p8_leaks_per_item,
        "p8_near_copies": leakage.p8_near_copies,
    }


def oracle_sql():
    return {"p8_found": leakage.P8_FOUND_SQL, "p8_leaks_per_item": leakage.P8_LEAKS_SQL}
