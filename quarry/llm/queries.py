"""The operators' registered queries and their SQL."""

from __future__ import annotations

from quarry.llm import divergence, jaccard_join, language_id, lattice_dedup, lexical_search, line_crf, mixing, packing, pii, quality, secrets, sharding, url_filter
from quarry.llm.common import ship


def _shipped(query):
    def run(spark, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(query) for name, query in _QUERIES.items()}


_QUERIES = {
    "op1_sharding": sharding.op1,
    "op2_quality_rules": quality.op2,
    "op3_secret_scan": secrets.op3,
    "op4_lattice_dedup": lattice_dedup.op4,
    "op5_pii_semi_markov": pii.op5,
    "op6_language_id": language_id.op6,
    "op7_url_filter": url_filter.op7,
    "op8_mix_sources": mixing.op8,
    "op10_best_fit_packing": packing.op10,
    "op9_ngram_jaccard_join": jaccard_join.op9,
    "op11_source_divergence": divergence.op11,
    "op12_line_crf_quality": line_crf.op12,
    "op13_ranked_search": lexical_search.op13,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_url_filter": url_filter.oracle(),
        "op8_mix_sources": mixing.ORACLE,
        "op11_source_divergence": divergence.ORACLE,
        "op13_ranked_search": lexical_search.ORACLE,
    }
