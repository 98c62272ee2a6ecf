"""Question/query-corpus analytics as plain DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so executors need no copy of us.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
