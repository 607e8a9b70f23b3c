"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import OP5_SQL, op5_nearest_neighbours
from .bpe import op2_bpe
from .licenses import OP6_SQL, op6_license_scan
from .lm import op1_lm_scoring
from .minhash import OP9_SQL, op9_minhash_near_dedup
from .mixing import OP4_SQL, op4_mixing
from .mpeg import op7_mpeg_audio
from .quality import op3_quality
from .substring import OP10_SQL, op10_substring_dedup
from .toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scoring, op2_bpe, op3_quality, op4_mixing, op5_nearest_neighbours, op6_license_scan, op7_mpeg_audio, op8_toxicity, op9_minhash_near_dedup, op10_substring_dedup)}

ORACLE_SQL: dict[str, str] = {"op4_mixing": OP4_SQL, "op5_nearest_neighbours": OP5_SQL, "op6_license_scan": OP6_SQL, "op9_minhash_near_dedup": OP9_SQL, "op10_substring_dedup": OP10_SQL}
