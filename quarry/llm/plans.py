"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quarry.llm import lines, topk, warc
from quarry.llm.langid import op6_language_id
from quarry.llm.neardup_vectors import op9_vector_neardup
from quarry.llm.packing import op7_best_fit_packing
from quarry.llm.secrets import op5_secret_scan
from quarry.llm.sentencepieces import op10_sentencepiece
from quarry.llm.simhash import op3_simhash
from quarry.llm.sstable import op8_token_tables

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_warc": warc.op2_warc,
    "op3_simhash": op3_simhash,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_tables": op8_token_tables,
    "op9_vector_neardup": op9_vector_neardup,
    "op10_sentencepiece": op10_sentencepiece,
}
ORACLES: dict[str, str] = {"op1_topk": topk.ORACLE, "op2_warc": warc.ORACLE, "op4_line_dedup": lines.oracle()}
