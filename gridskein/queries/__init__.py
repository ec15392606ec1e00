"""Registered queries of the gridded-data operators, with their SQL."""

from . import fields, maps, objects, series, volumes

_MODULES = (fields, series, objects, volumes, maps)
QUERIES: dict = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL: dict = {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}


def flagship(spark, sf_dir):
    """Total deformation on the whole cube."""
    return QUERIES["diag_def_total"](spark, sf_dir)
