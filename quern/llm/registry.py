"""Queries of the training-text operators, and their SQL."""

from __future__ import annotations

from quern.llm.chat import OP1_SQL, op1_snapshot_collapse
from quern.llm.cotraining import op4_cotraining
from quern.llm.decontamination import op6_seed_and_align
from quern.llm.html_template import op8_template_deduction
from quern.llm.licenses import op9_patience_licenses
from quern.llm.near_dup import op2_simhash_dedup
from quern.llm.packing import op3_karmarkar_karp_packing
from quern.llm.repetition import op7_repetition_coverage
from quern.llm.secrets import op5_assignment_lexing
from quern.llm.warc import OP10_SQL, op10_seekable_warc

QUERIES = {
    "op1_snapshot_collapse": op1_snapshot_collapse,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_karmarkar_karp_packing": op3_karmarkar_karp_packing,
    "op4_cotraining": op4_cotraining,
    "op5_assignment_lexing": op5_assignment_lexing,
    "op6_seed_and_align": op6_seed_and_align,
    "op7_repetition_coverage": op7_repetition_coverage,
    "op8_template_deduction": op8_template_deduction,
    "op9_patience_licenses": op9_patience_licenses,
    "op10_seekable_warc": op10_seekable_warc,
}
ORACLES = {"op1_snapshot_collapse": OP1_SQL, "op10_seekable_warc": OP10_SQL}
