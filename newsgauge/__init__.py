"""newsgauge: text indices, activity panels and lead-lag statistics on Spark.

Every operator is a function from DataFrames to a DataFrame; Catalyst plans the work.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
