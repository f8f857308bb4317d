"""Business-registry reconciliation as PySpark DataFrame jobs."""

from registra.plans.control import ControlOptions, ControlResult, run_control
from registra.sources.registry import Registry, RegistryPaths, read_registry
from registra.sources.user_list import read_user_list

__all__ = [
    "ControlOptions",
    "ControlResult",
    "Registry",
    "RegistryPaths",
    "read_registry",
    "read_user_list",
    "run_control",
]
