"""A directory engine on Spark. Functions that run in tasks travel by value, so executors need no installed copy."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
