"""trafficlens: request-log analytics and cache/limit replays as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no copy of this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
