"""Registered queries, one module per block of operators."""

from importlib import import_module

MODULES = ("cleaning", "reports", "panels", "tests_stat", "risk_finance", "verification", "models", "clusters", "causal")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
