"""Transactional-outbox relay analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from sluice.config import Backend, RelayConfig

# Functions that run in tasks travel by value, so executors need no copy of
# the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Backend", "RelayConfig"]
