"""Operators for training-data pipelines; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Code that runs inside tasks travels with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
