"""Queries of the training-data operators by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import OP3_SQL, op3_ann
from .embedding_dup import OP5_SQL, op5_embedding_dup
from .infill import OP11_SQL, op11_infill
from .language import op2_language
from .licenses import OP9_SQL, op9_licenses
from .line_dedup import OP8_SQL, op8_line_dedup
from .long_repeats import OP13_SQL, op13_long_repeats
from .merkle import OP12_SQL, op12_merkle
from .mixing import OP4_SQL, op4_mixing
from .near_dup import OP10_SQL, op10_near_dup
from .packing import op7_packing
from .toxicity import op1_toxicity
from .url_filter import op6_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_language, op3_ann, op4_mixing, op5_embedding_dup, op6_url_filter, op7_packing, op8_line_dedup, op9_licenses, op10_near_dup, op11_infill, op12_merkle, op13_long_repeats)}


def oracle_sql() -> dict[str, str]:
    return {"op3_ann": OP3_SQL, "op4_mixing": OP4_SQL, "op5_embedding_dup": OP5_SQL, "op8_line_dedup": OP8_SQL, "op9_licenses": OP9_SQL, "op10_near_dup": OP10_SQL, "op11_infill": OP11_SQL, "op12_merkle": OP12_SQL, "op13_long_repeats": OP13_SQL}
