"""The queries of this subpackage and the SQL that checks those which SQL can express."""

from . import forms, garbled, languages, mixing, packing, personal, pieces, scans, sentences

MODULES = (garbled, pieces, scans, sentences, forms, languages, packing, mixing, personal)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
