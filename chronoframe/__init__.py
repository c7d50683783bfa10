"""chronoframe — Spark-native time-series feature engineering and forecast evaluation.

Every public function is ``DataFrame -> DataFrame`` (or ``Column -> Column``)
and is lazy unless its docstring says otherwise.  Series are keyed by a list
of partition columns (``keys``) and ordered by explicit columns (``order``);
the single-series case is ``keys=[]``.
"""

from chronoframe.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
