"""Registry of runnable queries, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docloom.sources.tables import Corpus


@dataclass(frozen=True)
class Entry:
    name: str
    ids: str
    run: Callable[[Corpus], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(ids: str, sql: str | None = None):
    """Register a function of a Corpus under its own name."""

    def wrap(fn: Callable[[Corpus], DataFrame]):
        if fn.__name__ in ENTRIES:
            raise ValueError(f"duplicate query {fn.__name__}")
        ENTRIES[fn.__name__] = Entry(fn.__name__, ids, fn, sql)
        return fn

    return wrap


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {n: (lambda spark, folder, e=e: e.run(Corpus(spark, folder))) for n, e in ENTRIES.items()}


def oracles() -> dict[str, str]:
    load()
    return {n: e.sql for n, e in ENTRIES.items() if e.sql}


def load() -> None:
    from docloom.plans import (  # noqa: F401
        cell_queries, corpus_queries, layout_queries, log_queries, multi_recall_queries, paragraph_queries, rendering_queries, retrieval_queries, stream_queries, text_queries,
    )
