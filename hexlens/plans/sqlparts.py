"""Reusable DuckDB SQL fragments for the oracle statements.

The oracles explode bytes into rows (``hex`` + two-character substrings), the
independent "pure SQL" formulation of every byte operator.
"""

FILES_CTE = """files AS (
  SELECT doc_id, source, lang,
         source || '/' || CAST(doc_id AS VARCHAR) || '.' || lang AS path,
         encode(text) AS content,
         CAST(octet_length(encode(text)) AS BIGINT) AS length
  FROM documents
)"""


def bytes_cte(name: str, src: str, start: int = 0, limit: str = "n") -> str:
    """``name(doc_id, pos, b)``: bytes of ``src.content`` from 0-based ``start``.

    ``pos`` is relative to ``start``; ``limit`` bounds the count (SQL over n).
    """
    return f"""{name}_hex AS (
  SELECT doc_id, hex(content) AS hx, CAST(octet_length(content) AS BIGINT) AS n FROM {src}
),
{name}_pos AS (
  SELECT doc_id, hx, unnest(range(CAST(greatest(least({limit}, n - {start}), 0) AS BIGINT))) AS pos
  FROM {name}_hex
),
{name} AS (
  SELECT doc_id, pos, ('0x' || substr(hx, 2 * (pos + {start}) + 1, 2))::INTEGER AS b FROM {name}_pos
)"""


def entropy_sql(count: str, total: str) -> str:
    return f"(-sum(({count})::DOUBLE / ({total}) * log2(({count})::DOUBLE / ({total}))) / 8.0 + 0.0)"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"
