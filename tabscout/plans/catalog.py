"""Imports every module of checked queries so the registry is complete."""

from __future__ import annotations

import importlib

from tabscout.plans.registry import ORACLES, QUERIES

MODULES = ("profiling", "shaping", "evaluation", "modelling")
for _module in MODULES:
    importlib.import_module(f"tabscout.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
