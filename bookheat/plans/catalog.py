"""Imports every query module and exposes the registered jobs and checks."""

from bookheat.plans import action_queries, graph_queries, heat_queries, io_queries, ledger_queries, model_queries, panel_queries, signal_queries, stream_queries  # noqa: F401
from bookheat.plans.registry import CHECKS, JOBS  # noqa: F401
