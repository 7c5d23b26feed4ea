"""The queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakemill.llm.common import ship
from lakemill.llm.jaccard import OP5_SQL, op5_jaccard
from lakemill.llm.media import op9_media
from lakemill.llm.mixing import OP10_SQL, op10_mixing
from lakemill.llm.packing import op1_packing
from lakemill.llm.pii import op8_pii
from lakemill.llm.quality import op6_quality
from lakemill.llm.suffixes import op7_suffixes
from lakemill.llm.toolcalls import op2_toolcalls
from lakemill.llm.topk import OP4_SQL, op4_topk
from lakemill.llm.toxicity import op3_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(plan: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return plan(spark, sf_dir)

    return run


_PLANS: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_toolcalls": op2_toolcalls,
    "op3_toxicity": op3_toxicity,
    "op4_topk": op4_topk,
    "op5_jaccard": op5_jaccard,
    "op6_quality": op6_quality,
    "op7_suffixes": op7_suffixes,
    "op8_pii": op8_pii,
    "op9_media": op9_media,
    "op10_mixing": op10_mixing,
}

QUERIES: dict[str, Query] = {name: _shipped(plan) for name, plan in _PLANS.items()}

ORACLES: dict[str, str] = {
    "op4_topk": OP4_SQL,
    "op5_jaccard": OP5_SQL,
    "op10_mixing": OP10_SQL,
}
