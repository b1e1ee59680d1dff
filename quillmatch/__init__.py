"""Document matching, scoring and parsing as Spark jobs."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
