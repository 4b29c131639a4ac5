"""All registered queries; importing this module fills the registry."""

from sluice.plans import attempts, calibrations, curves, gating, modelling, policies, tables, texts  # noqa: F401
from sluice.plans.registry import ENTRIES


def all_queries():
    return {name: entry.run for name, entry in ENTRIES.items()}


def all_oracles():
    return {name: entry.oracle() for name, entry in ENTRIES.items() if entry.sql is not None}
