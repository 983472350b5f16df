"""Review and text analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The two Python steps travel to the executors inside their tasks, so the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
