"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from .archive import OP4_SQL, op4_warc
from .decontaminate import OP3_SQL, op3_decontamination
from .embeddings import op6_embeddings
from .licences import OP5_SQL, op5_licences
from .mixing import OP10_SQL, op10_mixing
from .quality import op9_quality
from .sharding import OP8_ROWS_SQL, OP8_SQL, op8_sharding, op8_sharding_rows
from .simhash import op7_simhash
from .suffix_dedup import op1_suffix_dedup
from .tokens import op2_token_counts

QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_token_counts": op2_token_counts, "op3_decontamination": op3_decontamination, "op4_warc": op4_warc, "op5_licences": op5_licences, "op6_embeddings": op6_embeddings, "op7_simhash": op7_simhash, "op8_sharding": op8_sharding, "op8_sharding_rows": op8_sharding_rows, "op9_quality": op9_quality, "op10_mixing": op10_mixing}
ORACLE_SQL = {"op3_decontamination": OP3_SQL, "op4_warc": OP4_SQL, "op5_licences": OP5_SQL, "op8_sharding": OP8_SQL, "op8_sharding_rows": OP8_ROWS_SQL, "op10_mixing": OP10_SQL}
