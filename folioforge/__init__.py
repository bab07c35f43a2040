"""Bulk venue recommendation and catalogue processing as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# the functions of this package travel with the tasks: executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
