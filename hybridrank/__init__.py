"""hybridrank: a Spark-native hybrid retrieval, ranking and text-data engine."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
