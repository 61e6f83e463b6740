"""All core queries; importing the plan modules fills the registry."""

from __future__ import annotations

from tidemill.plans import curation, dialogue, experiments, grid, logs, pairing, reports, scoring, walks  # noqa: F401
from tidemill.plans.registry import ORACLES, QUERIES  # noqa: F401
