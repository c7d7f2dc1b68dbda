"""The registered queries over the given tables, with their SQL."""

from pairscreen.queries import metrics, resolving, retrieval, scoring, streams, sweeps, texts, training

_MODULES = (retrieval, resolving, scoring, sweeps, training, metrics, texts, streams)


def all_queries():
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def all_sql():
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
