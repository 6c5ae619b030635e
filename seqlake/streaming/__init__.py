"""Logs as streams: followers of a store, and newest-wins state of a stream."""

from .follow import *  # noqa: F403
