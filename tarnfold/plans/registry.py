"""All registered queries of the reference's operators, with their oracle SQL."""

from __future__ import annotations

from tarnfold.plans import curation, examples, groups, labels, quality, reports, texts  # noqa: F401
from tarnfold.plans.base import ORACLES, QUERIES  # noqa: F401
