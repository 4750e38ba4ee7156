"""Kinspan: a PySpark engine for sourced oral-history archives."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
