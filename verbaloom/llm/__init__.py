"""Training-data operators: ten whole-table stages that clean, deduplicate, scan and pack a text corpus.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so a worker needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
