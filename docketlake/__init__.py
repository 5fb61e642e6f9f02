"""docketlake: a DataFrame-first analytics library for legal and investigative data."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
