"""Composed audits and the registry of named queries."""

import importlib

FAMILIES = ("fairness", "data", "privacy", "governance", "model", "suite")


def load_registry():
    """The registry with every family of queries loaded."""
    for family in FAMILIES:
        importlib.import_module(f"probity.plans.{family}_queries")
    return importlib.import_module("probity.plans.registry")
