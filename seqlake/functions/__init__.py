"""Schemas, limits, errors and column expressions of the log."""

from .records import *  # noqa: F403
