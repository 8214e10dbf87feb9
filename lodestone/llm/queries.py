"""The queries of this subpackage, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from lodestone.llm import jaccard, warc
from lodestone.llm.alignment import op12_alignment
from lodestone.llm.bpe import op9_bpe
from lodestone.llm.matroska import op5_matroska
from lodestone.llm.mixing import op10_mix
from lodestone.llm.packing import op13_packing
from lodestone.llm.pii import op6_pii
from lodestone.llm.quality import op4_quality
from lodestone.llm.rules import op7_rules
from lodestone.llm.substrings import op2_substrings
from lodestone.llm.urls import op3_urls
from lodestone.llm.whitening import op11_whitening

QUERIES = {
    "op1_jaccard": jaccard.op1_jaccard,
    "op2_substrings": op2_substrings,
    "op3_urls": op3_urls,
    "op4_quality": op4_quality,
    "op5_matroska": op5_matroska,
    "op6_pii": op6_pii,
    "op7_rules": op7_rules,
    "op8_warc": warc.op8_warc,
    "op9_bpe": op9_bpe,
    "op10_mix": op10_mix,
    "op11_whitening": op11_whitening,
    "op12_alignment": op12_alignment,
    "op13_packing": op13_packing,
}

ORACLES: dict[str, str] = {
    "op1_jaccard": jaccard.ORACLE,
    "op8_warc": warc.ORACLE,
}
