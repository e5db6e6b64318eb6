"""The operators' queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from specloom.llm.decontaminate import OP4_SQL, op4_benchmark_decontamination
from specloom.llm.language import op2_language_id
from specloom.llm.license_scan import OP3_SQL, op3_license_scan
from specloom.llm.merkle import OP11_SQL, op11_merkle_manifest
from specloom.llm.mixing import OP8_SQL, op8_source_mixing
from specloom.llm.ngram_join import OP5_SQL, op5_ngram_jaccard_join
from specloom.llm.packing import op12_packing
from specloom.llm.quality_model import op6_quality_classifier
from specloom.llm.quality_rules import ABLATION_SQL, OP1_SQL, op1_quality_rules, rule_ablation
from specloom.llm.spelling import OP13_SQL, op13_spelling_variants
from specloom.llm.toxicity import op10_toxicity
from specloom.llm.url_filter import OP7_SQL, op7_url_filter
from specloom.llm.warc import OP9_SQL, op9_warc

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_license_scan, op4_benchmark_decontamination, op5_ngram_jaccard_join, op6_quality_classifier, op7_url_filter, op8_source_mixing, op9_warc, op10_toxicity, op11_merkle_manifest, op12_packing, op13_spelling_variants, rule_ablation)}

SQL = {"op1_quality_rules": OP1_SQL, "op3_license_scan": OP3_SQL, "op4_benchmark_decontamination": OP4_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op7_url_filter": OP7_SQL, "op8_source_mixing": OP8_SQL, "op9_warc": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op13_spelling_variants": OP13_SQL, "rule_ablation": ABLATION_SQL}
