"""The operators as queries over the given tables, with their expected results in SQL."""

from __future__ import annotations

from .bpe import op3_bpe
from .cover_tree import OP4_SQL, op4_cover_tree
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .line_dedup import OP8_SQL, op8_line_dedup
from .merkle import OP12_SQL, op12_merkle_manifest
from .minhash import OP7_SQL, op7_minhash
from .mixing import OP9_SQL, op9_mix_sources
from .phrases import OP11_SQL, op11_phrases
from .quality_rules import OP13_SQL, op13_quality_rules
from .suffix_dedup import op6_suffix_dedup
from .toxicity import op2_toxicity
from .url_filters import OP5_SQL, op5_url_filter
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_cover_tree": op4_cover_tree,
    "op5_url_filter": op5_url_filter,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_minhash": op7_minhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_phrases": op11_phrases,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_quality_rules": op13_quality_rules,
}

ORACLES = {
    "op1_warc": OP1_SQL,
    "op4_cover_tree": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op7_minhash": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_mix_sources": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_phrases": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_quality_rules": OP13_SQL,
}
