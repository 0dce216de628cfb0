"""tidewise: distributed data profiling, preparation, feature and
model-evaluation library on Spark DataFrames.

Every step takes and returns DataFrames. Only methods whose name contains
``fit``, ``train`` or ``improve`` run Spark actions; everything else builds a
lazy plan that Catalyst optimises as a whole.
"""

from tidewise.roles import Roles
from tidewise.session import get_spark, checkpoint_dir

__all__ = ["Roles", "get_spark", "checkpoint_dir"]
