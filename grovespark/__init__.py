"""Spark-native analytics over collections of labelled ordered trees."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors inside the task, so no
# executor needs the package on its own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
