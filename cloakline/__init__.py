"""Sensitive-data scanning, scoring and removal as DataFrame plans."""

from __future__ import annotations

from .plans.options import PRESETS, Options


def queries() -> dict:
    from .catalogue import QUERIES

    return dict(QUERIES)


def oracles() -> dict:
    from .catalogue import ORACLES

    return dict(ORACLES)


def flagship(spark, sf_dir: str):
    from .catalogue import flagship as run

    return run(spark, sf_dir)


__all__ = ["PRESETS", "Options", "flagship", "oracles", "queries"]
