"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from quern.llm import conversation_repair, decontaminate, exact_dedup, license_scan, line_dedup, lm_score, minhash_dedup, packing, resample, substring_dedup, token_count, toxicity, vector_search
from quern.llm.common import table


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("text")


def op2_token_count(spark, sf_dir):
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op3_lm_score(spark, sf_dir):
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, toxicity.severity_grades(table(spark, sf_dir, "labels")), "severity"))


def op5_packing(spark, sf_dir):
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op7_line_dedup(spark, sf_dir):
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents")).drop("text")


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_license_scan(spark, sf_dir):
    return license_scan.licenses(license_scan.document_files(table(spark, sf_dir, "documents")))


def op10_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_groups(table(spark, sf_dir, "documents")).drop("k1", "k2")


def op11_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damage(rows), rows)


def op12_nearest_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vector_search.search(vector_search.build_index(rows), rows.filter("vec_id % 100 = 0"))


def op13_importance_resample(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words", "k2")


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_token_count, op3_lm_score, op4_toxicity, op5_packing,
        op6_decontaminate, op7_line_dedup, op8_exact_dedup, op9_license_scan, op10_minhash_dedup,
        op11_conversation_repair, op12_nearest_neighbours, op13_importance_resample,
    )
}
ORACLE = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op10_minhash_dedup": minhash_dedup.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op13_importance_resample": resample.SQL,
}
