"""Queries of the corpus operators, by name, and the SQL that they are held against."""

from __future__ import annotations

from tessera.llm.decontamination import OP4_SQL, op4_decontamination
from tessera.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from tessera.llm.langid import op1_language_id
from tessera.llm.license_scan import op5_license_scan
from tessera.llm.ngram_join import OP8_SQL, op8_ngram_join
from tessera.llm.packing import op2_packing
from tessera.llm.quality import op9_quality
from tessera.llm.suffix_dedup import op7_suffix_dedup
from tessera.llm.toxicity import op6_toxicity
from tessera.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
}

ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op4_decontamination": OP4_SQL, "op8_ngram_join": OP8_SQL, "op10_warc": OP10_SQL}
