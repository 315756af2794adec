"""tidegauge: panels of economic time series on Spark.

Every public function takes and returns lazy DataFrames. The long table
``(series_id, data, value)`` is the working form; wide tables exist only at the edges.
"""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
