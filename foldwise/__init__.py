"""foldwise: leak-free out-of-fold analytics on Spark DataFrames.

Folds are a keyed table, target encodings and past-only features are joins,
aggregates and windows, metrics are grouped aggregates, blends are
distributed passes with a tiny driver-side solve. Nothing is keyed by row
position; every alignment is a key join.
"""

from foldwise.session import checkpoint_dir, local_session, scratch_path
from foldwise.spec import TaskSpec

__all__ = ["TaskSpec", "checkpoint_dir", "local_session", "scratch_path"]
