"""Registered queries of the core operators and their SQL twins."""

from . import corpus, evaluation

QUERIES: dict = {**corpus.QUERIES, **evaluation.QUERIES}
SQL: dict = {**corpus.SQL, **evaluation.SQL}
