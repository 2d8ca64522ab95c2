"""PySpark-native engine for deterministic shipping-document verification."""

import sys

from pyspark import cloudpickle

# functions for executors travel with their code, so that workers need not have this repository installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
