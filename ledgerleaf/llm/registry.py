"""Queries of the training-data operators, with production parameters, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.llm.common import load
from ledgerleaf.llm.op1_quality import op1_quality
from ledgerleaf.llm.op2_jaccard_join import jaccard_join
from ledgerleaf.llm.op3_license_scan import op3_license_scan
from ledgerleaf.llm.op4_token_orc import op4_token_orc
from ledgerleaf.llm.op5_link_graph import op5_link_graph
from ledgerleaf.llm.op6_decontamination import op6_decontamination
from ledgerleaf.llm.op7_repeats import op7_repeats
from ledgerleaf.llm.op8_personal_data import op8_personal_data
from ledgerleaf.llm.op9_sharding import op9_sharding
from ledgerleaf.llm.op10_packing import op10_packing
from ledgerleaf.llm.op11_repair import op11_repair
from ledgerleaf.llm.op12_token_counts import op12_token_counts
from ledgerleaf.llm.op13_whitening import op13_whitening


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir, "documents"), width=3, percent=90)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_jaccard_join, op3_license_scan, op4_token_orc, op5_link_graph, op6_decontamination, op7_repeats,
        op8_personal_data, op9_sharding, op10_packing, op11_repair, op12_token_counts, op13_whitening,
    )
}
#: None of the queries has its rows through plain SQL on whole tables: each is tested against brute force in tests/llm.
ORACLES: dict[str, str] = {}
