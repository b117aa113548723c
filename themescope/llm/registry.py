"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import archives, bit_sliced, bpe, chosen_path, exact_index, filter_audit, fingerprints, hidden_markov, license_scan, mixing, quality_model, quality_rules, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_quality_classifier": quality_model.op3_quality_classifier,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_ngram_jaccard": chosen_path.op5_ngram_jaccard,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_hidden_markov": hidden_markov.op9_hidden_markov,
    "op10_warc": archives.op10_warc,
    "op11_exact_index": exact_index.op11_exact_index,
    "op12_bit_sliced_search": bit_sliced.op12_bit_sliced_search,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLE_SQL = {"op8_mix_sources": mixing.OP8_SQL, "op10_warc": archives.OP10_SQL, "op11_exact_index": exact_index.OP11_SQL, "op12_bit_sliced_search": bit_sliced.OP12_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
