"""De-identification of text, records, logs and streams on Spark.

Functions that run in Python workers are pickled by value, so executors need no copy of the
package.
"""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
