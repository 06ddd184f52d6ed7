"""Tender evaluation analytics and training-data operators as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so they need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
