"""The numbered queries over whole tables, and DuckDB SQL for those that SQL expresses at full size."""

from __future__ import annotations

from sheaf.session import table

from . import binpack, decontam, flac, langid, licenses, linededup, neardup, packing, pii, prefixes, secrets, spelling, substrings


def op1_secret_spans(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op2_flac_media(spark, sf_dir):
    return flac.media_report(table(spark, sf_dir, "documents"))


def pcm_blocks_of_documents(spark, sf_dir):
    return flac.block_report(table(spark, sf_dir, "documents"))


def op3_line_winnowing(spark, sf_dir):
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op4_vector_packing(spark, sf_dir):
    return packing.packing_report(table(spark, sf_dir, "documents"))


def packed_conversations(spark, sf_dir):
    return packing.conversation_report(table(spark, sf_dir, "conversations"))


def op5_language_crf(spark, sf_dir):
    return langid.language_report(table(spark, sf_dir, "documents"))


def op6_license_templates(spark, sf_dir):
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op7_minhash_bayes(spark, sf_dir):
    return neardup.duplicate_report(table(spark, sf_dir, "documents"))


def op8_private_terms(spark, sf_dir):
    return pii.private_report(table(spark, sf_dir, "documents"))


def op9_suffix_automata(spark, sf_dir):
    return substrings.repeat_report(table(spark, sf_dir, "documents"))


def op10_spaced_seed_overlaps(spark, sf_dir):
    return decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_heavy_paths(spark, sf_dir):
    return prefixes.trie_report(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.variant_report(table(spark, sf_dir, "documents"))


def op13_configuration_lp(spark, sf_dir):
    return binpack.best_fit_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_spans": op1_secret_spans,
    "op2_flac_media": op2_flac_media,
    "op3_line_winnowing": op3_line_winnowing,
    "op4_vector_packing": op4_vector_packing,
    "op5_language_crf": op5_language_crf,
    "op6_license_templates": op6_license_templates,
    "op7_minhash_bayes": op7_minhash_bayes,
    "op8_private_terms": op8_private_terms,
    "op9_suffix_automata": op9_suffix_automata,
    "op10_spaced_seed_overlaps": op10_spaced_seed_overlaps,
    "op11_heavy_paths": op11_heavy_paths,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_configuration_lp": op13_configuration_lp,
    "pcm_blocks_of_documents": pcm_blocks_of_documents,
    "packed_conversations": packed_conversations,
}
ORACLES: dict[str, str] = {
    "op3_line_winnowing": linededup.LINE_SQL,
    "op9_suffix_automata": substrings.REPEAT_SQL,
    "op11_heavy_paths": prefixes.TRIE_SQL,
}
