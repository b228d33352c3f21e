"""Training-data operators: near-duplicates, licences, personal data, vectors, tokens, language models.

Nothing else in the library imports this subpackage; ``queries.py`` registers its queries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
