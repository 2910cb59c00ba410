"""Readers and writers of landed data."""

import sys

from pyspark import cloudpickle

# The page reader runs in tasks and travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
