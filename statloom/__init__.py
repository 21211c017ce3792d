"""Regional statistics analytics on Spark.

Functions that run in Spark's Python workers are sent along with the tasks, so the package
has to be installed only where the driver runs.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
