"""replicata: a PySpark-native engine for assay-style measurement tables.

Every operator takes and returns a DataFrame.  Functions that run inside Python
workers are pickled by value, so that executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
