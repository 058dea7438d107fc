"""Registered queries over the adapter views, each beside its SQL oracle."""

from __future__ import annotations

from tracewright.plans import evaluation, evidence, features, models, network, walks  # noqa: F401  they register their queries
from tracewright.plans.adapters import Views
from tracewright.plans.registry import FOUND


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
