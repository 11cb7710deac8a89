"""Column functions. Those that run Python in Arrow batches travel by value, so executors need no copy of the repository."""

import sys

from pyspark import cloudpickle

import lafzspark.resources

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(lafzspark.resources)
