"""SQL fragments that several oracle queries share (DuckDB dialect, written independently of the Spark code)."""

CLEAN_SQL = "nullif(upper(trim(motif, ' ' || chr(9) || chr(10) || chr(13))), '')"


def root_sql(text: str) -> str:
    """Primitive root of a SQL string expression."""
    return f"left({text}, CAST(list_filter(range(1, length({text}) + 1), lambda d: length({text}) % d = 0 AND repeat(left({text}, CAST(d AS BIGINT)), CAST(length({text}) // d AS BIGINT)) = {text})[1] AS BIGINT))"


def rotation_sql(text: str) -> str:
    """Least rotation of a SQL string expression."""
    return f"list_min(list_transform(range(1, length({text}) + 1), lambda i: substring({text}, i) || left({text}, CAST(i - 1 AS BIGINT))))"


CANONICAL_SQL = f"(SELECT {rotation_sql('r')} FROM (SELECT {root_sql('c')} AS r FROM (SELECT {CLEAN_SQL} AS c)))"
