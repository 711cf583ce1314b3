"""Operators for preparing training text. Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Task functions travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
