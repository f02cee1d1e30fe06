"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tendersieve.plans.domain import AWARDS_SQL, TENDERS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``@t`` and ``@a`` in its SQL stand for tenders and awards."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            with_ = [x for key, x in (("@t", TENDERS_SQL), ("@a", AWARDS_SQL)) if key in sql]
            body = sql.replace("@t", "t").replace("@a", "a").strip()
            if with_:
                body = f"WITH {', '.join(with_)}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"
            ORACLE_SQL[name] = body
        return f

    return put
