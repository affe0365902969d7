"""The queries of the operators, and their SQL where it can say the same."""

from __future__ import annotations

from groundspan.llm import (
    decontamination,
    edit_counts,
    hard_negatives,
    language_id,
    license_scan,
    line_quality,
    minimax_shards,
    one_bit_search,
    periodic_runs,
    pieces,
    simhash,
    toxicity,
    url_filter,
)
from groundspan.llm.tables import table


def op1_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op2_sharding(spark, sf):
    return minimax_shards.sharding_query(table(spark, sf, "documents"))


def op3_language_id(spark, sf):
    return language_id.language_query(table(spark, sf, "documents"))


def op4_license_scan(spark, sf):
    return license_scan.license_query(table(spark, sf, "documents"))


def op5_edit_counts(spark, sf):
    return edit_counts.edit_count_query(table(spark, sf, "documents"))


def op6_decontamination(spark, sf):
    return decontamination.decontamination_query(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op7_pieces(spark, sf):
    return pieces.pieces_query(table(spark, sf, "documents"))


def op8_one_bit_search(spark, sf):
    return one_bit_search.search_query(table(spark, sf, "embeddings"))


def op9_url_filter(spark, sf):
    return url_filter.url_query(table(spark, sf, "pages"))


def op10_toxicity(spark, sf):
    return toxicity.toxicity_query(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op11_hard_negatives(spark, sf):
    return hard_negatives.negatives_query(table(spark, sf, "embeddings"))


def op12_line_quality(spark, sf):
    return line_quality.quality_query(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op13_periodic_runs(spark, sf):
    return periodic_runs.runs_query(table(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_sharding,
        op3_language_id,
        op4_license_scan,
        op5_edit_counts,
        op6_decontamination,
        op7_pieces,
        op8_one_bit_search,
        op9_url_filter,
        op10_toxicity,
        op11_hard_negatives,
        op12_line_quality,
        op13_periodic_runs,
    )
}

ORACLE_SQL = {
    "op6_decontamination": decontamination.ORACLE_SQL,
    "op8_one_bit_search": one_bit_search.ORACLE_SQL,
    "op9_url_filter": url_filter.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
}
