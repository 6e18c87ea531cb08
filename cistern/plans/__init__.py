"""Registered queries over the given tables."""

from .registry import CHECKS, QUERIES, Query


def _load() -> None:
    from . import (  # noqa: F401
        q_buildcache,
        q_details,
        q_dims,
        q_facts,
        q_logs,
        q_metrics,
        q_pipelines,
        q_sources,
        q_streaming,
        q_upkeep,
    )


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def checks() -> dict[str, str]:
    _load()
    return dict(CHECKS)
