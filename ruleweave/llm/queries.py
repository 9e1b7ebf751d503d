"""The queries and SQL that this subpackage registers."""

from __future__ import annotations

from .collocations import OP12_SQL, op12_phrase_collocations
from .decontamination import OP2_SQL, op2_benchmark_decontamination
from .divergence import OP11_SQL, op11_source_divergence
from .html import op6_html_extraction
from .language import op10_language_id
from .packing import op13_packing
from .pieces import op4_sentencepiece
from .pii import op1_pii
from .quality import op3_quality_rules
from .simhash import op8_simhash_near_dedup
from .substrings import OP5_SQL, op5_suffix_array_dedup
from .token_files import op7_token_files
from .warc import OP9_SQL, op9_warc


def queries() -> dict:
    return {
        "op1_pii": op1_pii,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_quality_rules": op3_quality_rules,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_html_extraction": op6_html_extraction,
        "op7_token_files": op7_token_files,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_warc": op9_warc,
        "op10_language_id": op10_language_id,
        "op11_source_divergence": op11_source_divergence,
        "op12_phrase_collocations": op12_phrase_collocations,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": OP2_SQL, "op5_suffix_array_dedup": OP5_SQL, "op9_warc": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_phrase_collocations": OP12_SQL}
