"""Tablewright: table quality, cleaning, insight, drift and analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Send our task functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
