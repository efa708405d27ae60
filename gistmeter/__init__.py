"""gistmeter - summary quality metrics as Spark jobs over a pair table (id, text, summary)."""

import sys

from pyspark import cloudpickle

# Python functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
