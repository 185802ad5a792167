"""Operators for large training-data corpora, one module each.

Nothing else in :mod:`waymesh` imports this subpackage.  Its functions run inside Spark's Python
workers; they are pickled by value, so executors need numpy and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
