"""Queries and SQL of the corpus operators, for the entry module."""

from __future__ import annotations

from .decontaminate import OP7_SQL, op7_decontamination, op7_proximity
from .embed_dup import op6_embedding_dup
from .line_dedup import OP4_SQL, OP4_WHOLE_SQL, op4_line_dedup, op4_line_dedup_whole
from .merkle import OP11_SQL, op11_merkle_manifest
from .near_dup import op2_near_dup
from .packing import op5_packing
from .quality import op8_quality
from .quality_rules import OP12_SQL, op12_quality_rules
from .sql import OP1_SQL, OP2_SQL, OP6_SQL
from .substring_dedup import op1_substring_dedup
from .token_store import op3_token_store
from .url_filter import OP9_SQL, op9_url_filter
from .vector_codes import OP13_SQL, op13_vector_codes
from .warc import OP10_SQL, op10_warc


def queries():
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_near_dup": op2_near_dup,
        "op3_token_store": op3_token_store,
        "op4_line_dedup": op4_line_dedup,
        "op4_line_dedup_whole": op4_line_dedup_whole,
        "op5_packing": op5_packing,
        "op6_embedding_dup": op6_embedding_dup,
        "op7_decontamination": op7_decontamination,
        "op7_proximity": op7_proximity,
        "op8_quality": op8_quality,
        "op9_url_filter": op9_url_filter,
        "op10_warc": op10_warc,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_quality_rules": op12_quality_rules,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql():
    return {"op1_substring_dedup": OP1_SQL, "op2_near_dup": OP2_SQL, "op6_embedding_dup": OP6_SQL, "op4_line_dedup": OP4_SQL, "op4_line_dedup_whole": OP4_WHOLE_SQL, "op7_decontamination": OP7_SQL, "op9_url_filter": OP9_SQL, "op10_warc": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_vector_codes": OP13_SQL}
