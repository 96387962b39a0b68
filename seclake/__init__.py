"""Security scanning of text tables, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
