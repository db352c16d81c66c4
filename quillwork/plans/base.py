"""Derived views over the standard tables, and the two ways a query is registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Views in SQL that Spark and DuckDB both read.
VIEWS = {
    "components": """
        SELECT CAST(floor(p_partkey / 50.0) AS BIGINT) AS profile, p_partkey AS component, 'a' AS part, p_brand AS vendor, p_type AS product,
               concat_ws('.', CAST(p_size AS STRING), CAST(p_partkey % 10 AS STRING), CAST(p_partkey % 3 AS STRING)) AS version
        FROM part""",
    "terms": """
        SELECT concat('CVE-2024-', CAST(min(p_partkey) AS STRING)) AS cve, p_brand AS vendor, p_type AS product,
               CAST(NULL AS STRING) AS exact, concat(CAST(min(p_size) AS STRING), '.0') AS lower,
               concat(CAST(CAST(floor((min(p_size) + max(p_size)) / 2) AS INT) AS STRING), '.5') AS upper,
               min(p_partkey) % 2 = 0 AS lower_inclusive, min(p_partkey) % 3 = 0 AS upper_inclusive
        FROM part GROUP BY p_brand, p_type""",
    "score_rows": """
        SELECT r.*, CASE WHEN valid AND pred = 1 AND truth = 1 THEN 1 ELSE 0 END AS tp,
               CASE WHEN truth = 0 AND (pred = 1 OR NOT valid) THEN 1 ELSE 0 END AS fp,
               CASE WHEN truth = 1 AND (pred = 0 OR NOT valid) THEN 1 ELSE 0 END AS fn
        FROM (SELECT d.doc_id AS profile, d.lang AS stratum, d.source AS section, d.n_chars AS n_chars, l.doc_id IS NOT NULL AS valid,
                     CASE WHEN l.doc_id IS NULL THEN d.doc_id % 2 ELSE l.quality END AS truth,
                     CASE WHEN d.n_chars > 1200 THEN 1 ELSE 0 END AS pred
              FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) r""",
    "cells": """
        SELECT l_suppkey AS profile, l_partkey % 98 AS cve, l_shipmode_tier AS tier, l_orderkey % 5 AS repetition,
               CASE WHEN gold AND said THEN 1 ELSE 0 END AS tp, CASE WHEN said AND NOT gold THEN 1 ELSE 0 END AS fp,
               CASE WHEN gold AND NOT said THEN 1 ELSE 0 END AS fn
        FROM (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber % 3 + 1 AS l_shipmode_tier,
                     l_returnflag = 'A' AS gold, l_linestatus = 'F' AS said FROM lineitem) c""",
    "tiers": """
        SELECT o_orderpriority AS tier, CAST(year(o_orderdate) AS BIGINT) AS repetition, o_custkey % 2 AS executor,
               round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 9) AS f1, count(*) AS n
        FROM orders GROUP BY o_orderpriority, CAST(year(o_orderdate) AS BIGINT), o_custkey % 2""",
    "frames": """
        SELECT user_id AS gpu, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS sequence, at_s,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value, 3) END AS power
        FROM (SELECT user_id, event_id, ts, value, {epoch} AS at_s FROM events) e""",
    "evaluations": """
        SELECT concat('main/model:', CAST(o_custkey % 3 AS STRING), '/', CASE WHEN o_custkey % 2 = 0 THEN 'on' ELSE 'off' END, '/T', CAST(o_orderkey % 3 + 1 AS STRING),
                      '/R', CAST(o_orderkey % 5 + 1 AS STRING), '/r', CAST(o_orderkey % 8 AS STRING), '/incumbent/item_', CAST(o_orderkey AS STRING)) AS key,
               o_orderkey AS id, o_totalprice AS latency, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey % 997 END AS tokens, o_orderdate AS finished
        FROM orders""",
}
_EPOCH = {"spark": "CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1000000", "duck": "CAST(epoch_us(ts) AS DOUBLE) / 1000000"}


def expand(sql: str, sf_dir: str | None = None) -> str:
    """Views spelt out; tables as files for Spark (sf_dir), as they are for DuckDB (None)."""

    def name(m: re.Match) -> str:
        word = m.group(2)
        if word in VIEWS:
            view = VIEWS[word].replace("{epoch}", _EPOCH["spark" if sf_dir else "duck"])
            return f"{m.group(1)} ({expand(view, sf_dir)})" + ("" if re.match(r"\s+(?!(?:WHERE|GROUP|ORDER|JOIN|LEFT|ON|USING|UNION|HAVING|CROSS|SEMI|ANTI|LIMIT|QUALIFY)\b)[A-Za-z_]+", sql[m.end() :]) else f" {word}")
        return f"{m.group(1)} parquet.`{sf_dir}/{word}.parquet` {word}" if sf_dir and not _aliased(sql, m.end()) else f"{m.group(1)} parquet.`{sf_dir}/{word}.parquet`" if sf_dir else m.group(0)

    return re.sub(rf"\b(FROM|JOIN)\s+({'|'.join([*VIEWS, *TABLES])})\b(?!\s*\()", name, sql)


def _aliased(sql: str, at: int) -> bool:
    return bool(re.match(r"\s+(?!(?:WHERE|GROUP|ORDER|JOIN|LEFT|ON|USING|UNION|HAVING|CROSS|SEMI|ANTI|LIMIT|QUALIFY)\b)[A-Za-z_]+", sql[at:]))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a derived view."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(expand(f"SELECT * FROM {name}", sf_dir))


Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """The queries of a module, with the SQL that checks them."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a DataFrame query; sql is written for DuckDB and independent of it."""

        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql:
                self.sql[name] = expand(sql)
            return query

        return register

    def check(self, name: str, sql: str) -> None:
        """The SQL of a query that another module registers."""
        self.sql[name] = expand(sql)
