"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat_format
from .crosspolytope import op4_cross_polytope
from .hardnegatives import OP12_SQL, op12_hard_negatives
from .jaccard import op1_ngram_jaccard
from .licences import op6_licence_scan
from .linerules import OP11_SQL, op11_line_rules
from .lyndonruns import op13_periodic_runs
from .mixing import OP5_SQL, op5_source_mix
from .quality import op10_quality
from .repeats import OP8_SQL, op8_substring_dedup
from .sentencepieces import op3_sentencepiece
from .syncmers import op7_syncmer_fingerprint
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_chat_format": op2_chat_format,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_cross_polytope": op4_cross_polytope,
    "op5_source_mix": op5_source_mix,
    "op6_licence_scan": op6_licence_scan,
    "op7_syncmer_fingerprint": op7_syncmer_fingerprint,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_line_rules": op11_line_rules,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL = {
    "op2_chat_format": OP2_SQL,
    "op5_source_mix": OP5_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_warc": OP9_SQL,
    "op11_line_rules": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
