"""Operators of a training-data pipeline over documents, vectors, pages and conversations.

Nothing else in the package imports this subpackage.  Functions that run in Python workers
are pickled by value, so executors need no copy of it.
"""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
