"""Layered (raw -> clean -> aggregated) table and stream operators on PySpark."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
