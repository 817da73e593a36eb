"""Spark-native analytics for (time, entity) panels.

Functions travel to the executors by value, so that these need no copy of the
repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
