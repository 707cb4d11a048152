"""Evidence-table operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# kernels travel to the executors with the job, so nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
