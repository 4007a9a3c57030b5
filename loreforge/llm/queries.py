"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_alignment
from .decontaminate import SQL as DECONTAMINATION_SQL
from .decontaminate import op8_decontamination
from .exact import SQL as EXACT_SQL
from .exact import op13_exact
from .language import op5_language
from .packing import op10_packing
from .phrases import SQL as PHRASES_SQL
from .phrases import op11_phrases
from .simple8b import op7_simple8b
from .quality import op1_quality
from .simhash import op9_simhash
from .sketch import op2_sketch
from .suffix_tree import op6_suffix_tree
from .toxicity import op4_toxicity
from .warc import SQL as WARC_SQL
from .warc import op3_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality, "op2_sketch": op2_sketch, "op3_warc": op3_warc, "op4_toxicity": op4_toxicity, "op5_language": op5_language, "op6_suffix_tree": op6_suffix_tree, "op7_simple8b": op7_simple8b, "op8_decontamination": op8_decontamination, "op9_simhash": op9_simhash, "op10_packing": op10_packing, "op11_phrases": op11_phrases, "op12_alignment": op12_alignment, "op13_exact": op13_exact}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": WARC_SQL, "op8_decontamination": DECONTAMINATION_SQL, "op11_phrases": PHRASES_SQL, "op13_exact": EXACT_SQL}
