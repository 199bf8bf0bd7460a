"""Registered queries, grouped by subject; each pairs a Spark plan with an equivalent SQL text."""

from __future__ import annotations

import importlib

SUBJECTS = ["filters", "ordered", "joins", "aggregates", "conditioning", "calendar_events", "reshaping", "analyses", "effects", "features", "modelling", "attribution"]


def load_all() -> dict:
    from hourgrid.plans.registry import REGISTRY

    for subject in SUBJECTS:
        importlib.import_module(f"hourgrid.plans.{subject}")
    return REGISTRY
