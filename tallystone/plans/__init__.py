"""Queries over the driver tables, each beside the SQL that states its result."""

from __future__ import annotations

from tallystone.plans import bundles, crosswalk, files, households, library, linkage, outputs, panels, places, shaping, shares, texts  # noqa: F401
from tallystone.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
