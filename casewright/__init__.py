"""casewright: outcome-oriented process analytics on event logs, written for Spark."""

import sys

from pyspark import cloudpickle

from .schema import LogSchema, known_logs

__all__ = ["LogSchema", "known_logs"]

# Code that runs inside tasks travels with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
