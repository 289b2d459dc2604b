"""datasteward: data-governance operators as PySpark DataFrame programs."""

import sys

from pyspark import cloudpickle

# ship the package's own functions with each task, so that executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
