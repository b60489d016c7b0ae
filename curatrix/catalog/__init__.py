"""All registered queries; importing a section registers it."""

from curatrix.catalog import evaluation, jobs, learning, neighbours, profiles, ranks, rows, scalars, scans  # noqa: F401
from curatrix.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
