"""Operators on health records."""

import sys

from pyspark import cloudpickle

# Executors have no copy of this package: functions that run in their tasks travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
