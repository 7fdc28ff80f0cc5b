"""DuckDB definitions of the fixture views, written independently of the
Spark code (windows where Spark uses joins, string functions of DuckDB).

Each entry is the body of a CTE; :func:`with_views` prepends the ones a
query needs (and their dependencies) as a ``WITH`` clause.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_pairs": ((), """
        SELECT conv_id * 1048576 + turn AS row_id, conv_id, text AS instruction, next_text AS response
        FROM (SELECT conv_id, turn, role, text,
                     lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
                     lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
              FROM conversations) t
        WHERE role = 'user' AND next_role = 'assistant'"""),
    "v_corpus": ((), """
        SELECT doc_id AS row_id,
               CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS client_id,
               lang AS category,
               CASE WHEN strpos(text, chr(10)) = 0 THEN text
                    ELSE substr(text, 1, strpos(text, chr(10)) - 1) END AS instruction,
               CASE WHEN strpos(text, chr(10)) = 0 THEN ''
                    ELSE substr(text, strpos(text, chr(10)) + 1) END AS response
        FROM documents"""),
    "v_alpaca": (("v_corpus",), """
        SELECT row_id, client_id, category, instruction,
               CASE WHEN row_id % 2 = 0 THEN '' ELSE category END AS input,
               response AS output,
               instruction || ' ' || response AS text
        FROM v_corpus"""),
    "v_updates": ((), """
        SELECT CAST(0 AS INTEGER) AS round, CAST(l_suppkey % 10 AS INTEGER) AS client_id,
               l_returnflag || l_linestatus AS key, CAST(l_linenumber AS INTEGER) AS pos,
               avg(l_discount) AS value
        FROM lineitem GROUP BY 2, 3, 4"""),
    "v_client_sizes": ((), """
        SELECT CAST(l_suppkey % 10 AS INTEGER) AS client_id, count(*) AS n
        FROM lineitem GROUP BY 1"""),
    "v_contrib": ((), """
        SELECT user_id AS author, event_type AS key, sum(value) AS value
        FROM events GROUP BY 1, 2"""),
    "v_medical": (("v_pairs",), """
        SELECT row_id, instruction AS Description, instruction AS Patient, response AS Doctor
        FROM v_pairs"""),
    "v_raw_gen": (("v_pairs",), """
        SELECT row_id AS round_id,
               CASE WHEN row_id % 7 <> 0 THEN chr(10) || '##instruction: ' || chr(10) || instruction || chr(10)
                         || '##output:' || chr(10) || response || chr(10) || chr(10) || '###example:' || chr(10)
                    WHEN (row_id // 7) % 3 = 0 THEN '##instruction: ' || instruction
                    WHEN (row_id // 7) % 3 = 1 THEN '##instruction: ' || instruction || ' ##output: ' || response
                         || ' ### example more'
                    ELSE '##instruction: ' || instruction || ' ##output: ' || response || ' ##instruction: again'
               END AS text
        FROM v_pairs"""),
    "v_sides": ((), """
        SELECT vec_id, CASE WHEN label < 5 THEN 0 ELSE 1 END AS side, embedding FROM embeddings"""),
}


def with_views(*names: str, extra: str = "") -> str:
    """``WITH`` clause holding the named views (dependencies first) + ``extra`` CTEs."""
    order: list[str] = []

    def visit(n):
        deps, _ = VIEWS[n]
        for d in deps:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order]
    if extra:
        ctes.append(extra)
    return "WITH " + ",\n".join(ctes) + "\n" if ctes else ""


def md5_key(key: str, seed) -> str:
    """DuckDB twin of ``functions.keys.hash_key`` for one key column."""
    return f"md5(CAST({key} AS VARCHAR) || ':' || '{seed}')"


def md5_pos(parts: list[str], seed, n: str) -> str:
    """DuckDB twin of ``functions.keys.hash_pos``."""
    inner = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + f" || ':' || '{seed}'"
    return f"(('0x' || substr(md5({inner}), 1, 15))::BIGINT % ({n}))"
