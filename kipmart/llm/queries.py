"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kipmart.llm import common
from kipmart.llm.op1_token_output import op1_token_output
from kipmart.llm.op10_neighbour_graph import op10_neighbour_graph
from kipmart.llm import op11_importance_resampling as op11
from kipmart.llm import op12_source_divergence as op12
from kipmart.llm import op13_secret_scan as op13
from kipmart.llm.op2_toxicity import op2_toxicity
from kipmart.llm.op3_packing import op3_packing
from kipmart.llm.op4_language_id import op4_language_id
from kipmart.llm import op5_decontamination as op5
from kipmart.llm.op6_token_counts import op6_token_counts
from kipmart.llm.op7_html_extraction import op7_html_extraction
from kipmart.llm import op8_jaccard_join as op8
from kipmart.llm.op9_quality_classifier import op9_quality_classifier

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return query(spark, sf_dir)
    return run


_ALL: dict[str, Query] = {
    "op1_token_output": op1_token_output,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5.op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_html_extraction": op7_html_extraction,
    "op8_jaccard_join": op8.op8_jaccard_join,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_neighbour_graph": op10_neighbour_graph,
    "op11_importance_resampling": op11.op11_importance_resampling,
    "op12_source_divergence": op12.op12_source_divergence,
    "op13_secret_scan": op13.op13_secret_scan,
}

QUERIES: dict[str, Query] = {name: _shipped(query) for name, query in _ALL.items()}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": op5.ORACLE,
    "op8_jaccard_join": op8.ORACLE,
    "op11_importance_resampling": op11.ORACLE,
    "op12_source_divergence": op12.ORACLE,
    "op13_secret_scan": op13.ORACLE,
}
