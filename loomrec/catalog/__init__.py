"""Registered queries of the core and their SQL twins."""

from __future__ import annotations

from loomrec.catalog import guards, rating, similarity, skew, structure

_MODULES = (structure, similarity, rating, guards, skew)


def queries():
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}


def flagship(spark, folder):
    return similarity.recommend_itemknn(spark, folder)
