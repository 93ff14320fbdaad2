"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import oracles
from .decontamination import op7_decontamination
from .fill_in_middle import op13_fill_in_middle
from .jaccard_join import op9_jaccard_join
from .language_id import op10_language_id
from .license_scan import op5_license_scan
from .mixing import op12_source_mixing
from .packing import op6_packing
from .quality_classifier import op1_quality_classifier
from .quality_rules import op8_quality_rules
from .spelling_variants import op11_spelling_variants
from .token_counts import op2_token_counts
from .token_files import op3_token_files
from .toxicity import op4_toxicity


def queries() -> dict:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_token_counts": op2_token_counts,
        "op3_token_files": op3_token_files,
        "op4_toxicity": op4_toxicity,
        "op5_license_scan": op5_license_scan,
        "op6_packing": op6_packing,
        "op7_decontamination": op7_decontamination,
        "op8_quality_rules": op8_quality_rules,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_language_id": op10_language_id,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_source_mixing": op12_source_mixing,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    """The other queries train a model, read files back or hold a method's own verdict; tests/llm has their plain versions."""
    return {"op7_decontamination": oracles.DECONTAMINATION, "op9_jaccard_join": oracles.JACCARD_JOIN, "op12_source_mixing": oracles.SOURCE_MIXING, "op13_fill_in_middle": oracles.FILL_IN_MIDDLE}
