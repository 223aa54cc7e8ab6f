"""Queries of the training-data operators and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decontaminate, html_text, ngram_join, pieces, quality_rules, secrets, simhash, sql, suffix, tiered, toxicity, warc, weak_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": weak_quality.op1_quality_classifier,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_simhash": simhash.op4_simhash,
    "op5_suffix_array": suffix.op5_suffix_array,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_warc": warc.op10_warc,
    "op11_jaccard_join": ngram_join.op11_jaccard_join,
    "op12_tiered_search": tiered.op12_tiered_search,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = dict(sql.ORACLES)
