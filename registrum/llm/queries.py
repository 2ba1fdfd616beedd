"""The queries of this subpackage, by name, and the SQL that DuckDB can run for them."""

from __future__ import annotations

from registrum.llm.decontaminate import op1_benchmark_decontamination
from registrum.llm.fingerprints import op11_document_fingerprints
from registrum.llm.interactions import OP13_SQL, op13_filter_interaction_audit
from registrum.llm.licenses import op4_license_scans
from registrum.llm.merkle import OP12_SQL, op12_merkle_dataset_manifest
from registrum.llm.packing import op2_best_fit_packing
from registrum.llm.personal_data import op5_personal_data
from registrum.llm.quality_model import op8_quality_classifier
from registrum.llm.quality_rules import OP9_SQL, op9_quality_rules
from registrum.llm.repeats import OP10_SQL, op10_suffix_array_dedup
from registrum.llm.secrets import OP6_SQL, op6_secret_scans
from registrum.llm.simhash import op3_simhash_near_dedup
from registrum.llm.tokens import op7_token_counts

_ALL = [
    op1_benchmark_decontamination, op2_best_fit_packing, op3_simhash_near_dedup, op4_license_scans, op5_personal_data, op6_secret_scans, op7_token_counts, op8_quality_classifier, op9_quality_rules,
    op10_suffix_array_dedup, op11_document_fingerprints, op12_merkle_dataset_manifest, op13_filter_interaction_audit,
]
QUERIES = {q.__name__: q for q in _ALL}

#: The others need fingerprints, tokenizers, learned models or alignments; tests hold them against brute force.
ORACLES: dict[str, str] = {"op6_secret_scans": OP6_SQL, "op9_quality_rules": OP9_SQL, "op10_suffix_array_dedup": OP10_SQL, "op12_merkle_dataset_manifest": OP12_SQL, "op13_filter_interaction_audit": OP13_SQL}
