"""The subpackage's queries and their DuckDB SQL, by name."""

from __future__ import annotations

from .dartminhash import op5_near_duplicates
from .decontaminate import op9_decontamination
from .exact_dedup import ORACLE as EXACT_DEDUP_SQL
from .exact_dedup import op6_exact_dedup
from .gru_lm import op1_lm_score
from .hyperdim import op8_language_id
from .materialise import op4_training_order
from .packing import op3_packing
from .templates import op2_main_text
from .pseudonyms import op7_pseudonyms
from .recompression import op10_repeated_passages

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_main_text": op2_main_text,
    "op3_packing": op3_packing,
    "op4_training_order": op4_training_order,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_repeated_passages": op10_repeated_passages,
}
ORACLE_SQL = {"op6_exact_dedup": EXACT_DEDUP_SQL}
