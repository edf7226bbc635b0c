"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import importlib

from treeloom.llm import chat, decontamination, embeddings, licenses, lm_scoring, mixing, ngram_join, quality, secrets, toxicity


def pipeline(spark, sf_dir):
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries():
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_chat_formatting": chat.op3_chat_formatting,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_mixing": mixing.op7_mixing,
        "op8_lm_scoring": lm_scoring.op8_lm_scoring,
        "op9_embedding_dedup": embeddings.op9_embedding_dedup,
        "op10_quality": quality.op10_quality,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {
        "op1_license_scan": licenses.OP1_SQL,
        "op2_decontamination": decontamination.OP2_SQL,
        "op3_chat_formatting": chat.OP3_SQL,
        "op4_ngram_join": ngram_join.OP4_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op9_embedding_dedup": embeddings.OP9_SQL,
    }
