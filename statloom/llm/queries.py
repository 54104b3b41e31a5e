"""The training-data operators' queries and their SQL twins."""

from __future__ import annotations

from statloom.llm import decontamination, licenses, line_dedup, quality_rules
from statloom.llm.decontamination import op6_decontamination
from statloom.llm.html_extract import op4_html_extract
from statloom.llm.language_id import op10_language_id
from statloom.llm.licenses import op9_license_scan
from statloom.llm.line_dedup import op2_line_dedup
from statloom.llm.minhash import op1_minhash_near_dedup
from statloom.llm.mixing import op5_mixing
from statloom.llm.pii import op3_pii_surrogates
from statloom.llm.quality_classifier import op7_quality_classifier
from statloom.llm.quality_rules import op8_quality_rules

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_html_extract": op4_html_extract,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
}

ORACLE: dict[str, str] = {
    "op2_line_dedup": line_dedup.SQL,
    "op6_decontamination": decontamination.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op9_license_scan": licenses.SQL,
}
