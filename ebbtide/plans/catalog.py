"""Imports every plan module so that its queries are registered."""

from ebbtide.plans import (  # noqa: F401
    features, learning, panels, raw, scored, storage, summaries, text,
)
from ebbtide.plans.base import ORACLE_BODIES, QUERIES, compose

ORACLES = {name: compose(body) for name, body in ORACLE_BODIES.items()}

__all__ = ["ORACLES", "QUERIES"]
