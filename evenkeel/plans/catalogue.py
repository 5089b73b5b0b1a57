"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = ("population_queries", "ranking_queries", "source_queries", "estimator_queries", "prediction_queries",
           "diagnostic_queries", "signature_queries", "annotation_queries", "synthesis_queries")

for _m in MODULES:
    try:
        importlib.import_module(f".{_m}", __package__)
    except ModuleNotFoundError as missing:
        if not str(missing.name).endswith(_m):
            raise

__all__ = ["ORACLES", "QUERIES"]
