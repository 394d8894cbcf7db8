"""gridframe: a PySpark-native engine for gridded and tabular data.

Functions and classes of the package are pickled by value, so executors need
not have it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
