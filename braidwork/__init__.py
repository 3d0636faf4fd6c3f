"""Spark-native analytics of matrix-shaped data and of web pages grouped by site."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors inside their closures: no installation on the workers is needed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
