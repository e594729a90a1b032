"""All core queries; importing the modules registers them."""

from __future__ import annotations

from lodestar.plans import adapter, audits, builds, catalogue, inference, storage, vectors, works  # noqa: F401
from lodestar.plans.catalog import ORACLES, QUERIES  # noqa: F401
