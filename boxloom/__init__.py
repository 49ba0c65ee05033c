"""Spark-native curation and evaluation of object-detection datasets."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# helpers travel to the executors by value, so a cluster needs no installation of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
