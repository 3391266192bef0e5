"""Corridor impact on land, computed with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions of it that run there are sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
