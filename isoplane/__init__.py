"""Response-surface modelling on Spark DataFrames.

Rows stay in Spark: they are aggregated to one row per experimental condition
and only that size-checked summary, or a fixed-size sum over the rows, ever
reaches a dense solve.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no
# separate copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
