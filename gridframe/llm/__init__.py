"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
Functions of the package are pickled by value, so executors need not have it
on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
