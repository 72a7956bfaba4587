"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from lociflow.llm.decontam import op3
from lociflow.llm.divergence import op12
from lociflow.llm.fuzzy_lines import op8
from lociflow.llm.language_id import op6
from lociflow.llm.lengths import op5
from lociflow.llm.lm_scoring import op2
from lociflow.llm.mixing import op10
from lociflow.llm.near_dup import op1
from lociflow.llm.pfor import op7
from lociflow.llm.quality import op11
from lociflow.llm.snapshot_diff import op13
from lociflow.llm.sql import DIVERGENCE, MIXING, SNAPSHOT, TOP_K
from lociflow.llm.suffix_dedup import op4
from lociflow.llm.topk import op9

QUERIES = {
    "op1_simhash_near_dup": op1,
    "op2_gru_lm_scoring": op2,
    "op3_spaced_seed_decontamination": op3,
    "op4_suffix_array_dedup": op4,
    "op5_token_length_histogram": op5,
    "op6_hyperdimensional_language_id": op6,
    "op7_token_id_blocks": op7,
    "op8_fuzzy_line_dedup": op8,
    "op9_branch_and_bound_top_k": op9,
    "op10_poisson_mixing": op10,
    "op11_fourier_quality": op11,
    "op12_source_divergence": op12,
    "op13_snapshot_difference": op13,
}

SQL = {"op10_poisson_mixing": MIXING, "op9_branch_and_bound_top_k": TOP_K, "op12_source_divergence": DIVERGENCE, "op13_snapshot_difference": SNAPSHOT}
