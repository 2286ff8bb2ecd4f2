"""Full-text search, ranking and faceting on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to executors with their code: no package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
