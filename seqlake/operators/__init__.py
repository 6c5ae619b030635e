"""Operators on logs: DataFrame in, DataFrame out; they work on any DataFrame with the columns of a log."""

from .accounting import *  # noqa: F403
from .reads import *  # noqa: F403
from .state import *  # noqa: F403
from .writes import *  # noqa: F403
