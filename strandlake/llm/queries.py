"""The queries of the text operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.bm25 import op7_bm25
from strandlake.llm.bpe import op2_bpe
from strandlake.llm.chat_format import OP10_SQL, op10_chat_format
from strandlake.llm.collocations import OP12_SQL, op12_collocations
from strandlake.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from strandlake.llm.html_extract import op5_html_extract
from strandlake.llm.language_model import op3_language_model
from strandlake.llm.near_dedup import op9_near_dedup
from strandlake.llm.packing import op6_packing
from strandlake.llm.quality_rules import op4_quality_rules
from strandlake.llm.recompress import op8_passage_dedup
from strandlake.llm.suffix_dedup import op1_suffix_dedup
from strandlake.llm.toxicity import op11_toxicity
from strandlake.llm.twins import OP1_SQL, OP4_SQL, OP8_SQL, OP9_SQL


def _over(operator: Callable[..., DataFrame], *tables: str):
    return lambda spark, sf_dir: operator(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": _over(op1_suffix_dedup, "documents"),
        "op2_bpe": _over(op2_bpe, "documents"),
        "op3_language_model": _over(op3_language_model, "documents"),
        "op4_quality_rules": _over(op4_quality_rules, "documents", "labels"),
        "op5_html_extract": _over(op5_html_extract, "pages"),
        "op6_packing": _over(op6_packing, "documents"),
        "op7_bm25": _over(op7_bm25, "documents"),
        "op8_passage_dedup": _over(op8_passage_dedup, "documents"),
        "op9_near_dedup": _over(op9_near_dedup, "documents"),
        "op10_chat_format": _over(op10_chat_format, "conversations"),
        "op11_toxicity": _over(op11_toxicity, "documents", "labels"),
        "op12_collocations": _over(op12_collocations, "documents"),
        "op13_hard_negatives": _over(op13_hard_negatives, "embeddings"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op4_quality_rules": OP4_SQL, "op8_passage_dedup": OP8_SQL, "op9_near_dedup": OP9_SQL, "op10_chat_format": OP10_SQL, "op12_collocations": OP12_SQL, "op13_hard_negatives": OP13_SQL}
