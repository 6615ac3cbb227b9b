"""Market-data analytics and corpus operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel by value, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
