"""Scalar Column helpers (all JVM-side expressions, no Python UDFs)."""

from trailmark.functions.exprs import *  # noqa: F401,F403
