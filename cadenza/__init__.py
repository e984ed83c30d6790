"""Cadenza: a PySpark-native engine for timed speech and text tables.

Operators are plain ``DataFrame -> DataFrame`` functions with column-name
parameters; Catalyst plans them.  ``cadenza.llm`` holds the operators for
training data and is imported by nothing else in this package.
"""

import sys

from pyspark import cloudpickle

#: Executors need no installed copy: functions of this package travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
