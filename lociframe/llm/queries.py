"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociframe.llm.embedding import op2_projection_forest_dedup
from lociframe.llm.maxent import op6_maxent_lm
from lociframe.llm.minhash import op7_lsh_forest_dedup
from lociframe.llm.packing import op4_sum_of_squares_packing
from lociframe.llm.pieces import op10_max_plus_pieces
from lociframe.llm.pii import op1_anchor_pii
from lociframe.llm.quality import op5_decision_list_quality
from lociframe.llm.sharding import op3_rendezvous_sharding
from lociframe.llm.toxicity import op8_crf_toxicity
from lociframe.llm.url_filters import ORACLE_SQL as OP9_SQL
from lociframe.llm.url_filters import op9_temporal_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_anchor_pii,
            op2_projection_forest_dedup,
            op3_rendezvous_sharding,
            op4_sum_of_squares_packing,
            op5_decision_list_quality,
            op6_maxent_lm,
            op7_lsh_forest_dedup,
            op8_crf_toxicity,
            op9_temporal_url_filters,
            op10_max_plus_pieces,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_temporal_url_filters": OP9_SQL}
