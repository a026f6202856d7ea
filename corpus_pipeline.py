"""The corpus pipeline: quality, near-duplicates, benchmark passages, source weights, token ids."""

from __future__ import annotations

from tessera.llm import decontaminate, mixing, quality, simhash, tokens
from tessera.llm.common import new_folder, remove_folder, table


def quality_stage(spark, docs, sf_dir):
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark, docs, sf_dir):
    return simhash.keep_one(docs)


def decontamination_stage(spark, docs, sf_dir):
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs, sf_dir):
    return mixing.mixed(docs)


def tokens_stage(spark, docs, sf_dir):
    return tokens.tokenized(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_output", tokens_stage),
]

#: Fits, components and a schedule are beyond SQL; tests/llm compares each stage with a plain version of its own.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents; each result is written to the shared folder and read again by the next, then deleted."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove_folder(spark, before)
        before = folder
    last = STAGES[-1][1](spark, docs, sf_dir)  # its result no longer depends on what it read
    remove_folder(spark, before)
    return last
