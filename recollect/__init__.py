"""Memory analytics on Spark: search, classification, ingestion, growth and access analytics as DataFrames."""

import sys

from pyspark import cloudpickle

#: Functions travel to the executors with their code, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
