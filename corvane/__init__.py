"""Text-overlap, matching and clustered-inference analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are sent by value, so that a cluster need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
