"""The registered queries of this subpackage, and their SQL."""

from reviewloom.llm import (
    chat, decontaminate, licenses, line_dedup, mixing, ngram_join, periodic, prefix_trie, quality,
    quality_rules, recompress, repeats, secrets,
)
from reviewloom.llm.common import table


def op1_mix_sources(spark, folder):
    return mixing.query(table(spark, folder, "documents"))


def op2_ngram_jaccard_join(spark, folder):
    return ngram_join.query(table(spark, folder, "documents"))


def op3_quality_classifier(spark, folder):
    return quality.query(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_secret_scan(spark, folder):
    return secrets.query(table(spark, folder, "documents"))


def op5_quality_rules(spark, folder):
    return quality_rules.query(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_line_dedup(spark, folder):
    return line_dedup.query(table(spark, folder, "documents"))


def op7_chat_format(spark, folder):
    return chat.query(table(spark, folder, "conversations"))


def op8_repeated_strings(spark, folder):
    return repeats.query(table(spark, folder, "documents"))


def op9_license_scan(spark, folder):
    return licenses.query(table(spark, folder, "documents"))


def op10_decontamination(spark, folder):
    return decontaminate.query(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_prefix_trie(spark, folder):
    return prefix_trie.query(table(spark, folder, "conversations"))


def op12_substring_dedup(spark, folder):
    return recompress.query(table(spark, folder, "documents"))


def op13_periodic_runs(spark, folder):
    return periodic.query(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f for f in (
        op1_mix_sources, op2_ngram_jaccard_join, op3_quality_classifier, op4_secret_scan,
        op5_quality_rules, op6_line_dedup, op7_chat_format, op8_repeated_strings,
        op9_license_scan, op10_decontamination, op11_prefix_trie,
        op12_substring_dedup, op13_periodic_runs)
}

ORACLE = {
    "op1_mix_sources": mixing.ORACLE,
    "op4_secret_scan": secrets.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_substring_dedup": recompress.ORACLE,
}
