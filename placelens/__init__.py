"""PySpark-native place search and site analytics: DataFrame in, DataFrame out."""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions sent to Python workers travel with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
