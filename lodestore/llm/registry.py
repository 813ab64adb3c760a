"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from lodestore.llm.byte_bpe import op8_byte_bpe
from lodestore.llm.embedding_dup import op2_embedding_near_dup
from lodestore.llm.html_text import op3_html_extraction
from lodestore.llm.media import op6_media_columns
from lodestore.llm.near_dup import op10_minhash_near_dup
from lodestore.llm.oracles import ORACLES
from lodestore.llm.packing import op9_packing
from lodestore.llm.pitman_yor import op4_pitman_yor
from lodestore.llm.secrets import op7_secret_scans
from lodestore.llm.token_counts import op1_token_counts
from lodestore.llm.toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_embedding_near_dup, op3_html_extraction, op4_pitman_yor, op5_toxicity, op6_media_columns, op7_secret_scans, op8_byte_bpe, op9_packing, op10_minhash_near_dup)}

__all__ = ["ORACLES", "QUERIES"]
