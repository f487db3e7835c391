"""The registered queries of this subpackage: each applies its operator to the whole table."""

from __future__ import annotations

from . import (
    decontamination,
    html_extraction,
    line_dedup,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    recompression,
    simhash,
    source_divergence,
    source_mixing,
    suffix_dedup,
    warc,
)
from .common import table

OPERATORS = {
    "op2_revisit_resolution": ("pages", warc.op2),
    "op3_sum_of_squares_packing": ("documents", packing.op3),
    "op4_recurrent_blocks": ("pages", html_extraction.op4),
    "op5_rule_ledger": ("documents", quality_rules.op5),
    "op6_recompression": ("documents", recompression.op6),
    "op7_simhash_blocks": ("documents", simhash.op7),
    "op8_induced_suffix_sorting": ("documents", suffix_dedup.op8),
    "op10_site_line_dedup": ("documents", line_dedup.op10),
    "op11_periodic_runs": ("documents", periodic_runs.op11),
    "op12_source_divergence": ("documents", source_divergence.op12),
    "op13_source_mixing": ("documents", source_mixing.op13),
}

SQL = {
    "op2_revisit_resolution": warc.SQL,
    "op6_recompression": recompression.SQL,
    "op10_site_line_dedup": line_dedup.SQL,
    "op12_source_divergence": source_divergence.SQL,
    "op13_source_mixing": source_mixing.SQL,
}


def queries() -> dict:
    found = {
        name: (lambda spark, sf_dir, t=t, f=f: f(table(spark, sf_dir, t))) for name, (t, f) in OPERATORS.items()
    }
    found["op9_qgram_decontamination"] = lambda spark, sf_dir: decontamination.op9(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    found["op1_quadratic_discriminant"] = quality_classifier.query
    return found


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
