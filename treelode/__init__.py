"""Code-corpus analytics on Spark: search, outlines, imports, trees and change logs.

Every operator takes and returns Spark DataFrames.  See ``treelode.plans.workspace``
for the high-level API and ``README.md`` for the operator map.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no copy of this
# package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
