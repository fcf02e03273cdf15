"""Document ingestion and vector search as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions used inside Spark tasks travel with the job, so executors need
# neither this package on their path nor a zip file shipped beforehand.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
