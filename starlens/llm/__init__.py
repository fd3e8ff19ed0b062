"""Training-data operators: thirteen numbered operators and their queries.

Nothing outside this package imports it; ``__spark_entry__`` adds its
queries when the package is present.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])
