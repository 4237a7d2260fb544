"""lectern: document and feed processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a job needs
# no copy of the package on the workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
