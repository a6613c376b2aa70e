"""Operators for large text collections that are to become training data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their tasks; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
