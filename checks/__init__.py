"""Queries over the driver's tables and the SQL they are compared with."""

MODULES = ["core", "formats", "knowledge", "investigation", "guarded", "profiles", "repositories"]


def load_all():
    from importlib import import_module

    for name in MODULES:
        import_module(f"checks.{name}")
    return import_module("checks.registry")
