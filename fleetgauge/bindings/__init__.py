"""The queries registered on the supplied tables."""

import importlib

MODULES = ["sources_sets", "rule_queries", "join_queries", "aggregate_queries", "history_queries", "overlap_queries",
           "reporting_queries", "report_queries", "stream_queries", "check_queries"]


def _load():
    from fleetgauge.bindings import registry
    for module in MODULES:
        importlib.import_module(f"fleetgauge.bindings.{module}")
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
