"""Registered queries and end-to-end plans."""

from tracemill.plans import events as _events  # these register their queries beside the first ones
from tracemill.plans import more as _more
from tracemill.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
