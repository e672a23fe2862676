"""Queries over the given tables, one module per operator group."""

import importlib

MODULES = (
    "q_sources",
    "q_quality",
    "q_entities",
    "q_temporal",
    "q_volume",
    "q_calibration",
    "q_bias",
    "q_micro",
    "q_text",
    "q_streaming",
)


def load() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"marketlens.plans.{name}")
