"""Spark-native analytics for large collections of short, noisy social comments."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
