"""All driver queries but those of the corpus operators, and their SQL."""

from . import kernel_queries, loader_queries  # noqa: F401  they add theirs
from .queries import ORACLES, QUERIES  # noqa: F401
