"""The registered queries over the driver's tables and, where SQL can express them, their oracles."""

from __future__ import annotations

from pagemill.plans import casebook, content, forms, layout, scalar, sensitive, structure

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (sensitive, scalar, structure, content, casebook, forms, layout):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
