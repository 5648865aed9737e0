"""Analytics over civic records and document corpora, declared as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
