"""DataFrame operators.  Each takes and returns DataFrames; nothing is collected but scalars."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pandas, but not this package
