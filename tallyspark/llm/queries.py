"""The queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.decontaminate import op4_decontaminate
from tallyspark.llm.language import op1_language
from tallyspark.llm.linededup import op8_linededup
from tallyspark.llm.neardup import op6_neardup
from tallyspark.llm.packing import op7_packing
from tallyspark.llm.quality import op2_quality
from tallyspark.llm.token_files import op3_token_files
from tallyspark.llm.topk import OP9_SQL, op9_topk
from tallyspark.llm.toxicity import op5_toxicity
from tallyspark.llm.urlfilter import op10_sql, op10_urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language,
        "op2_quality": op2_quality,
        "op3_token_files": op3_token_files,
        "op4_decontaminate": op4_decontaminate,
        "op5_toxicity": op5_toxicity,
        "op6_neardup": op6_neardup,
        "op7_packing": op7_packing,
        "op8_linededup": op8_linededup,
        "op9_topk": op9_topk,
        "op10_urlfilter": op10_urlfilter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_topk": OP9_SQL, "op10_urlfilter": op10_sql()}
