"""Operators for large training-data pipelines.  Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle as _cloudpickle

import budgetlens.llm as _self

# Executors get these functions by value, so that they need no copy of the library.
_cloudpickle.register_pickle_by_value(_self)
