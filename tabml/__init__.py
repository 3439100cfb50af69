"""Tabular AutoML as Spark jobs: profile, clean, prepare, train, evaluate, explain, score."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run inside tasks travel with the task, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
