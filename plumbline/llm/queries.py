"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op2_bpe
from .ctw import op5_ctw
from .decontaminate import op10_decontaminate
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .jaccard_join import op9_jaccard_join
from .language_id import op3_language_id
from .secrets import op6_secrets
from .sharding import op4_sharding
from .substring_dedup import op8_substring_dedup
from .token_counts import op7_token_counts

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_language_id": op3_language_id,
    "op4_sharding": op4_sharding,
    "op5_ctw": op5_ctw,
    "op6_secrets": op6_secrets,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontaminate": op10_decontaminate,
}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL}
