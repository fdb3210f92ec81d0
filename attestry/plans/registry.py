"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

REC = """rec AS (SELECT d.doc_id AS rid, d.lang AS site, d.source AS grp, d.n_chars,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE length(text) - length(replace(text, ' ', '')) END AS nsp,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE CAST(d.n_chars % 3 AS INT) END AS slope, l.quality AS y
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
PUB = "pub AS (SELECT rid AS pid, site, grp, n_chars, coalesce(nsp, 100 * y) AS nsp, coalesce(slope, y) AS slope, y FROM rec)"


def h32(*parts: str) -> str:
    """SQL of hash32: parts are SQL expressions."""
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def query(name: str, sql: str | None = None):
    """Registers the function as a query, with SQL where SQL can state it. @rec and @pub stand for the study frames."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.replace("@rec", REC).replace("@pub", PUB)
        return f

    return put
