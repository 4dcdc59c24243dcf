"""Transaction-graph analytics expressed as DataFrame -> DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors get our functions with the tasks, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
