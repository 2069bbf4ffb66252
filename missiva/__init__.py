"""missiva: Spark operators for dated, addressed document collections."""

import sys

from pyspark import cloudpickle

# Helpers inside pandas functions travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
