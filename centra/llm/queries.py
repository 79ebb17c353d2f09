"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op8_byte_bpe
from .language_id import op1_language_id
from .licenses import op7_licenses
from .lm_score import op2_lm_score
from .mixing import op10_mixing
from .neighbours import op9_nearest_neighbours
from .quality import OP5_SQL, op5_quality_rules
from .simhash import op4_simhash
from .substrings import op3_suffix_array
from .url_filter import OP6_SQL, op6_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_lm_score, op3_suffix_array, op4_simhash, op5_quality_rules, op6_url_filter, op7_licenses, op8_byte_bpe, op9_nearest_neighbours, op10_mixing)
}
ORACLE = {"op5_quality_rules": OP5_SQL, "op6_url_filter": OP6_SQL}
