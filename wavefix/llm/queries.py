"""The text operators' queries by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from wavefix.llm import collocations, decontamination, exact_dedup, line_dedup, near_dedup, packing, phrase_dedup, piece_encoding, quality, secret_scan, suffix_dedup, token_output, whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_packing": packing.query,
    "op2_quality": quality.query,
    "op3_decontamination": decontamination.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_secret_scan": secret_scan.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_token_output": token_output.query,
    "op8_line_dedup": line_dedup.query,
    "op9_phrase_dedup": phrase_dedup.query,
    "op10_near_dedup": near_dedup.query,
    "op11_collocations": collocations.query,
    "op12_whitening": whitening.query,
    "op13_piece_encoding": piece_encoding.query,
}

ORACLES = {
    "op3_decontamination": decontamination.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op6_suffix_dedup": suffix_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_phrase_dedup": phrase_dedup.ORACLE,
    "op10_near_dedup": near_dedup.ORACLE,
    "op11_collocations": collocations.ORACLE,
}
