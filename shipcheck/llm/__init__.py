"""Training-data operators: packing, quality, sharding, near-duplicates, media, URL filters,
mixing, language id, toxicity and personal data.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# functions for executors travel with their code, so that workers need not have this repository installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
