"""The registered queries of the panel operators and their SQL."""

from __future__ import annotations

from panelmill.plans import climatology, grid, models, stages, twostage

QUERIES = {**climatology.QUERIES, **grid.QUERIES, **models.QUERIES, **stages.QUERIES, **twostage.QUERIES}
ORACLES = {**climatology.ORACLES, **grid.ORACLES, **models.ORACLES, **stages.ORACLES, **twostage.ORACLES}
