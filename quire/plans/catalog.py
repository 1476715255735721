"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from quire.plans import deep, marks, pdfs, relations, scalars, structures, text


def queries() -> dict:
    return text.QUERIES | relations.QUERIES | scalars.QUERIES | pdfs.QUERIES | structures.QUERIES | marks.QUERIES | deep.QUERIES


def oracle_sql() -> dict:
    return text.SQL | relations.SQL | scalars.SQL | pdfs.SQL | structures.SQL | marks.SQL | deep.SQL
