"""A PySpark-native engine for sequence, interval and record analytics."""

import sys

from pyspark import cloudpickle

# Functions go to the executors whole, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
