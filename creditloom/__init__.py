"""Credit-risk and regulation analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with their code, so the package
# does not have to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
