"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from plumbline.plans import files, lifecycle, registry, relational, scalars, statistical  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
