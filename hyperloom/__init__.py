"""Hyperedge analytics on Spark: every operator is a function from DataFrame to DataFrame."""

import sys

from pyspark import cloudpickle

# Ship this package's functions with the tasks, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
