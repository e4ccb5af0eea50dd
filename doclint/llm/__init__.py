"""Training-data operators: each module holds one operator and its registered query.

The package is pickled by value, so executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
