"""Property-graph analytics on PySpark: typed nodes and edges as DataFrames, queried with Catalyst plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have this package installed: what runs in their Python workers travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
