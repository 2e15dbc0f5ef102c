"""All registered queries and their SQL."""

from __future__ import annotations

from kinmap.plans import files, images, kernels, matching, search

_GROUPS = (search, matching, images, files, kernels)


def queries() -> dict:
    return {name: f for group in _GROUPS for name, f in group.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
