"""Every query of the engine by name, with its SQL."""

from weftline.plans import banks, controls, extras, metrics, renders, sequences, vectors  # noqa: F401  they register themselves
from weftline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
