"""The registry of this subpackage: its queries, and their SQL where SQL can express them."""

from __future__ import annotations

from strandspark.llm import topk
from strandspark.llm.lines import op6_lines
from strandspark.llm.media import op7_media
from strandspark.llm.mixing import op4_mixing
from strandspark.llm.neardup import op5_neardup
from strandspark.llm.packing import op9_packing
from strandspark.llm.repeats import op10_repeats
from strandspark.llm.scoring import op2_scoring
from strandspark.llm.toxicity import op8_toxicity
from strandspark.llm.urls import op3_urls

QUERIES = {"op1_topk": topk.op1_topk, "op2_scoring": op2_scoring, "op3_urls": op3_urls, "op4_mixing": op4_mixing, "op5_neardup": op5_neardup, "op6_lines": op6_lines, "op7_media": op7_media, "op8_toxicity": op8_toxicity, "op9_packing": op9_packing, "op10_repeats": op10_repeats}
SQL: dict[str, str] = {"op1_topk": topk.SQL}
