"""Registered queries: each runs one operator over whole tables, most with a SQL counterpart."""


def load():
    from . import common, embedding, prediction, relevance, tables  # noqa: F401

    return dict(common.QUERIES), dict(common.ORACLE)
