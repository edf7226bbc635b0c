"""Similarity of control-flow and data-flow features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.functions.sets import count_similarity, map_cosine

#: Weights of blocks, edges, cyclomatic number, edge kinds, branching, loops and conditions.
CFG_WEIGHTS = (0.20, 0.15, 0.25, 0.25, 0.10, 0.05)
#: Weights of pairs, chain length, crossing share, definition and use kinds.
DFA_WEIGHTS = (0.25, 0.20, 0.20, 0.20, 0.15)
#: Shares of control flow and data flow.
SHARES = (0.60, 0.40)


def cfg_similarity(a: Column, b: Column) -> Column:
    """``a`` and ``b`` are structs of ``flow.cfg_features``; a missing side is unlike."""
    parts = [
        count_similarity(a["blocks"], b["blocks"]),
        count_similarity(a["edges"], b["edges"]),
        count_similarity(a["cyclomatic"], b["cyclomatic"]),
        map_cosine(a["kinds"], b["kinds"]),
        count_similarity(a["branching"], b["branching"]),
        count_similarity(a["loops"] + a["conditions"], b["loops"] + b["conditions"]),
    ]
    total = sum((p * w for p, w in zip(parts[1:], CFG_WEIGHTS[1:])), parts[0] * CFG_WEIGHTS[0])
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(total)


def dfa_similarity(a: Column, b: Column) -> Column:
    """Structs with pairs, chain_length, crossing, def_kinds and use_kinds."""
    parts = [
        count_similarity(a["pairs"], b["pairs"]),
        count_similarity(a["chain_length"], b["chain_length"]),
        count_similarity(a["crossing"], b["crossing"]),
        map_cosine(a["def_kinds"], b["def_kinds"]),
        map_cosine(a["use_kinds"], b["use_kinds"]),
    ]
    total = sum((p * w for p, w in zip(parts[1:], DFA_WEIGHTS[1:])), parts[0] * DFA_WEIGHTS[0])
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(total)


def combined(cfg: Column, dfa: Column | None) -> Column:
    """Control flow alone where data flow is missing."""
    return cfg if dfa is None else F.when(dfa.isNull(), cfg).otherwise(cfg * SHARES[0] + dfa * SHARES[1])
