"""Operators for training-data pipelines over a ``documents``-like table.

Nothing outside this subpackage imports it.  Conventions that hold for every operator here:

* an operator names the columns it reads and ignores all others, so extra columns never matter;
  where input columns are passed through, a result column replaces an input column of its name;
* a null text counts as empty, a null identifier is an ordinary value, repeated rows are rows of their own;
* an empty table gives an empty result of the same schema.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: what runs in their Python workers travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
