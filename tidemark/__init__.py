"""tidemark: Spark-first record pairing and event-stream alignment."""

import sys

from pyspark import cloudpickle

# Python workers get our functions with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
