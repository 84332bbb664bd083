"""bandloom: imaging-spectroscopy analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the workers with their code, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
