"""Operators for large training corpora: scoring, filtering, de-duplication, mixing, search and tokenisation.

Nothing else in the package imports this subpackage.  Functions that run inside Python workers are sent by value, so
executors need numpy and pyarrow but not this package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
