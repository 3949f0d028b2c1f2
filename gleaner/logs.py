"""Logging of the command line."""

from __future__ import annotations

import logging
import sys


def setup_logging(level: str = "INFO") -> None:
    """Everything of ``level`` and above to stderr; a level that isn't known counts as INFO."""
    number = logging.getLevelNamesMapping().get(level.upper(), logging.INFO)
    logging.basicConfig(level=number, stream=sys.stderr, format="%(levelname)s %(name)s: %(message)s", force=True)
    logging.getLogger("py4j").setLevel(max(number, logging.WARNING))
