"""A Spark-native engine for the quality and cost of text retrieval."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Executors get the library's functions by value, so that they need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
