"""Every runnable query, over the driver's tables."""

from . import ctes  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
from . import board, leagues, models, panel, research, weekly  # noqa: F401, E402
