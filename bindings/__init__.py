"""Wires the operators to the driver's tables."""

from importlib import import_module

MODULES = ("log_filters", "log_times", "log_stats", "telemetry", "calibration", "nested", "files")


def load_all():
    from bindings.registry import ORACLES, QUERIES

    for name in MODULES:
        try:
            import_module(f"bindings.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"bindings.{name}":
                raise
    return QUERIES, ORACLES
