"""Mail-archive analytics on Spark DataFrames.

Functions in this package are shipped to Python workers by value, so a
cluster needs no copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
