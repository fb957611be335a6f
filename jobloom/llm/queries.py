"""The queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from jobloom.llm import classifier, decontaminate, langid, licenses, linededup, merkle, packing, rules, sharding, simhash, suffixes, trie, wrappers

QUERIES = {
    "op1_classifier": classifier.op1_classifier,
    "op2_rules": rules.op2_rules,
    "op3_licenses": licenses.op3_licenses,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_suffixes": suffixes.op5_suffixes,
    "op6_simhash": simhash.op6_simhash,
    "op7_sharding": sharding.op7_sharding,
    "op8_extraction": wrappers.op8_extraction,
    "op9_packing": packing.op9_packing,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_trie": trie.op11_trie,
    "op12_merkle": merkle.op12_merkle,
    "op13_language": langid.op13_language,
}
SQL = {"op2_rules": rules.OP2_SQL, "op4_line_dedup": linededup.OP4_SQL, "op11_trie": trie.OP11_SQL, "op12_merkle": merkle.OP12_SQL}
