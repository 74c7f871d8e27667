"""Operators for preparing training corpora; self-contained, imported by nothing else in the library."""

import sys

from pyspark import cloudpickle

# functions travel to executors by value, so workers need no copy of the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
