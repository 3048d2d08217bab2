"""Motif algebra as column expressions: everything here stays in the JVM.

A motif is *primitive* when it is no whole-number power of a shorter string, and *canonical* when it is the
alphabetically least of its rotations. A primitive canonical motif is a Lyndon word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, although ``body`` names it many times."""
    return F.transform(F.array(value), body)[0]


def clean_motif(motif: Column) -> Column:
    """Upper case without outer blanks; null when nothing is left."""
    return F.nullif(F.upper(F.trim(motif, F.lit(BLANKS))), F.lit(""))


def primitive_root(text: Column) -> Column:
    """Shortest unit of which ``text`` is a whole number of copies; '' for '', null for null."""
    return F.regexp_extract(text, r"(?s)^(.+?)\1*$", 1)


def primitive_root_length(text: Column) -> Column:
    return F.length(primitive_root(text))


def is_primitive(text: Column) -> Column:
    """True for '' and single characters; null for null."""
    return F.length(primitive_root(text)) == F.length(text)


def least_rotation(text: Column) -> Column:
    """Alphabetically least rotation; '' for '', null for null.

    Rotations of long upper-case texts that hold an A are only tried where a run of A begins: no other can be least.
    """

    def rotate(t: Column) -> Column:
        whole = F.length(t)
        turned = F.transform(F.sequence(F.lit(1), whole), lambda i: F.concat(F.substring(t, i, whole), F.substring(t, F.lit(1), i - 1)))
        from_runs = F.filter(F.regexp_extract_all(F.concat(t, t), F.lit("(?<!A)(?=(A.*))"), F.lit(1)), lambda x: F.length(x) > whole)
        return F.when(whole <= 1, t).when((whole > 8) & t.rlike("^[B-Z]*A[A-Z]*$"), F.left(F.array_min(from_runs), whole)).otherwise(F.array_min(turned))

    return _let(text, rotate)


def is_lyndon(text: Column) -> Column:
    """True when ``text`` is non-empty, primitive and its own least rotation; null for null."""
    return (F.length(text) > 0) & is_primitive(text) & (least_rotation(text) == text)


def canonical_motif(motif: Column) -> Column:
    """The canonical spelling of a motif as called: cleaned, cut to its primitive root, least rotation.

    Null and blank motifs have none (null).
    """
    return least_rotation(primitive_root(clean_motif(motif)))
