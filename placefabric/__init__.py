"""A PySpark-native analytics engine for place discovery."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: functions sent to Python workers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
