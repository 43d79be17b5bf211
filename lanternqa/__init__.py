"""Open-domain question answering over document tables, as Spark jobs.

Sub-packages: ``functions`` (Column expressions), ``operators``
(DataFrame -> DataFrame stages), ``sources`` (file formats and stores),
``plans`` (fixtures and the registered queries), ``streaming``
(retrieval over a stream of questions).
"""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers are sent by value, so
# executors need neither the package on their path nor ``--py-files``.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
