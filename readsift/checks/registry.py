"""Collects the registered queries of all check modules."""

from __future__ import annotations

from readsift.checks import extraction, frames, learning, scoring, splits
from readsift.session import tune

_MODULES = (extraction, frames, splits, scoring, learning)


def _tuned(function):
    def run(spark, sf_dir):
        return function(tune(spark), sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    return run


def queries():
    return {name: _tuned(f) for module in _MODULES for name, f in module.BOOK.queries.items()}


def oracles():
    return {name: sql for module in _MODULES for name, sql in module.BOOK.oracles.items()}
