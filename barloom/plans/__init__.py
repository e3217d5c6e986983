"""Queries over the supplied tables, one module per operator family."""

from barloom.plans import (
    bar_queries,
    chain_queries,
    context_queries,
    ensemble_queries,
    indicator_queries,
    model_queries,
    score_queries,
    signal_queries,
    source_queries,
    structure_queries,
    vote_queries,
)
from barloom.plans.registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
