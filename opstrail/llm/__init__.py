"""Operators for preparing training text, one module each; queries and SQL sit beside them."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
