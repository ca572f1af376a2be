"""paramloom: parameter studies with memoised results, as Spark DataFrames.

Functions that run in Python workers are shipped with the task (pickled by
value), so executors need no copy of this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
