"""All registered queries: importing the theme modules fills the registry."""

from chronoframe.plans import (q_asof, q_calendar, q_cleaning, q_display, q_eval, q_features, q_keyed, q_linear, q_rows,  # noqa: F401
                              q_scenario, q_series, q_windows)
from chronoframe.plans.registry import ORACLE, QUERIES  # noqa: F401
