"""Registered queries with the SQL each must agree with."""

from pairmatch.registry import assets, images, links, pairs, vectors

_MODULES = [links, assets, pairs, vectors, images]


def queries():
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracles():
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
