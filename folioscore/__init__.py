"""folioscore: Spark jobs that evaluate and assemble document-to-Markdown conversions.

Every operator takes and returns DataFrames (or builds Columns); nothing here
collects data to the driver.
"""

import sys

from pyspark import cloudpickle

from folioscore.session import build_session, workspace

# Python functions of this package travel inside the tasks that call them, so
# executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "workspace"]
