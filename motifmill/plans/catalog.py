"""All core queries by name, and their SQL."""

from motifmill.plans import problems, repeats

QUERIES = {**repeats.QUERIES, **problems.QUERIES}
SQL = {**repeats.SQL, **problems.SQL}
