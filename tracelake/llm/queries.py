"""The registered queries of the subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tracelake.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark, sf_dir):
    from tracelake.llm.line_dedup import drop_boilerplate, host_of, lines_of_html

    found = drop_boilerplate(table(spark, sf_dir, "pages"), host_of(F.col("url")), lines_of_html(F.col("html")))
    return found.select("page_id", F.col("_host").alias("host"), F.col("_text").alias("text"), "n_lines", "n_dropped")


def op2_preference_format(spark, sf_dir):
    from tracelake.llm.preference import preference_pairs

    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    found = preference_pairs(table(spark, sf_dir, "conversations"), F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    return found.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", mask("chosen_spans").alias("chosen_mask"), mask("rejected_spans").alias("rejected_mask"))


def op3_best_fit_packing(spark, sf_dir):
    from tracelake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_quality_classifier(spark, sf_dir):
    from tracelake.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark, sf_dir):
    from tracelake.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark, sf_dir):
    from tracelake.llm.top_k import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_token_counts(spark, sf_dir):
    from tracelake.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


def op8_ngram_jaccard_join(spark, sf_dir):
    from tracelake.llm.near_dup import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_bloom_lm_score(spark, sf_dir):
    from tracelake.llm.bloom_lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)


def op9_benchmark_decontamination(spark, sf_dir):
    from tracelake.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_toxicity(spark, sf_dir):
    from tracelake.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations(spark, sf_dir):
    from tracelake.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark, sf_dir):
    from tracelake.llm.fill_middle import fill_in_middle, restored

    found = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    texts = digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *texts)


QUERIES = [
    op9_benchmark_decontamination, op10_bloom_lm_score, op5_suffix_dedup, op1_line_dedup, op2_preference_format, op3_best_fit_packing,
    op4_quality_classifier, op6_exact_top_k, op7_token_counts, op8_ngram_jaccard_join, op11_toxicity, op12_collocations, op13_fill_in_middle,
]


def queries():
    return {q.__name__: q for q in QUERIES}


def oracle_sql():
    from tracelake.llm import collocations, fill_middle, line_dedup, preference, top_k

    return {
        "op1_line_dedup": line_dedup.SQL, "op2_preference_format": preference.SQL, "op6_exact_top_k": top_k.SQL,
        "op12_collocations": collocations.SQL, "op13_fill_in_middle": fill_middle.SQL,
    }
