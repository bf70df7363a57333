"""Visual-question data preparation and evaluation as Spark DataFrame work."""

import sys

from pyspark import cloudpickle

# Python helpers travel to the executors with the job, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
