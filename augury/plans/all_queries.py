"""Imports every query module so that they register."""

from augury.plans import (  # noqa: F401
    queries_console,
    queries_data,
    queries_evaluation,
    queries_features,
    queries_incidents,
    queries_labels,
    queries_model,
    queries_rates,
    queries_streaming,
)
