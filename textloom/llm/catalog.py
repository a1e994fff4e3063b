"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from textloom.llm.capture_index import OP1_SQL, op1_capture_index
from textloom.llm.chat_format import OP2_SQL, op2_chat_format
from textloom.llm.decontamination import OP4_SQL, op4_decontamination
from textloom.llm.language_id import op3_language_id
from textloom.llm.media import op7_media_sniffing
from textloom.llm.near_duplicates import op5_near_duplicates
from textloom.llm.oracles import OP5_SQL, OP9_SQL
from textloom.llm.piece_encoding import op10_piece_encoding
from textloom.llm.suffix_repeats import op9_suffix_repeats
from textloom.llm.token_counts import op6_token_counts
from textloom.llm.url_filter import OP8_SQL, op8_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_capture_index,
        op2_chat_format,
        op3_language_id,
        op4_decontamination,
        op5_near_duplicates,
        op6_token_counts,
        op7_media_sniffing,
        op8_url_filter,
        op9_suffix_repeats,
        op10_piece_encoding,
    )
}
ORACLES = {"op1_capture_index": OP1_SQL, "op2_chat_format": OP2_SQL, "op4_decontamination": OP4_SQL, "op5_near_duplicates": OP5_SQL, "op8_url_filter": OP8_SQL, "op9_suffix_repeats": OP9_SQL}
