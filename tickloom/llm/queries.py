"""The registered queries of this subpackage and, where SQL can say them, their SQL."""
from __future__ import annotations

from .line_dedup import OP2_SQL, op2
from .manifest import OP13_SQL, op13
from .near_dups import op1
from .packing import op5
from .pieces import op7
from .prefix_trie import OP11_SQL, op11
from .quality import OP10_SQL, op10
from .secret_scan import op6
from .token_counts import op3
from .toxicity import op4
from .topk import OP9_SQL, op9
from .url_filter import OP12_SQL, op12
from .warc import OP8_SQL, op8

QUERIES = {
    "op1_minhash_near_dups": op1,
    "op2_line_dedup": op2,
    "op3_token_counts": op3,
    "op4_toxicity": op4,
    "op5_best_fit_packing": op5,
    "op6_secret_scan": op6,
    "op7_sentencepiece": op7,
    "op8_warc_revisits": op8,
    "op9_threshold_top_k": op9,
    "op10_quality_rules": op10,
    "op11_prefix_trie": op11,
    "op12_url_filter": op12,
    "op13_merkle_manifest": op13,
}
ORACLES = {
    "op2_line_dedup": OP2_SQL,
    "op8_warc_revisits": OP8_SQL,
    "op9_threshold_top_k": OP9_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_url_filter": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
