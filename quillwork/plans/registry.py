"""All queries of the library outside the optional subpackage, with the SQL that checks them."""

from __future__ import annotations

from quillwork.plans import applicability, audits, ordered, producers, records, replays, reports, scoring, streams, summaries, texts, workflow
from quillwork.plans.base import Query

_BOOKS = (applicability.BOOK, audits.BOOK, scoring.BOOK, ordered.BOOK, reports.BOOK, records.BOOK, producers.BOOK, replays.BOOK, summaries.BOOK, texts.BOOK, streams.BOOK, workflow.BOOK)


def queries() -> dict[str, Query]:
    return {name: query for book in _BOOKS for name, query in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in _BOOKS for name, sql in book.sql.items()}
