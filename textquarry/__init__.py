"""Search and analysis of large text and source collections on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
