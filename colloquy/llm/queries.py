"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from colloquy.llm.alignment import op12_alignment
from colloquy.llm.bpe import op13_bpe
from colloquy.llm.chat import OP4_SQL, op4_chat_format
from colloquy.llm.decontaminate import OP10_SQL, op10_decontaminate
from colloquy.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from colloquy.llm.html_extract import op1_html_extract
from colloquy.llm.licences import op3_licence_scan
from colloquy.llm.near_dedup import OP2_SQL, op2_near_dedup
from colloquy.llm.packing import op9_packing
from colloquy.llm.quality import op8_quality
from colloquy.llm.resampling import op11_resampling
from colloquy.llm.url_filter import op6_url_filter
from colloquy.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_near_dedup": op2_near_dedup,
    "op3_licence_scan": op3_licence_scan,
    "op4_chat_format": op4_chat_format,
    "op5_warc": op5_warc,
    "op6_url_filter": op6_url_filter,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_decontaminate": op10_decontaminate,
    "op11_resampling": op11_resampling,
    "op12_alignment": op12_alignment,
    "op13_bpe": op13_bpe,
}
ORACLES = {
    "op2_near_dedup": OP2_SQL,
    "op4_chat_format": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op10_decontaminate": OP10_SQL,
}
