"""Multi-fidelity error analytics on Spark DataFrames."""

from .functions.columns import error_decomposition, escalate_once, reference_blind
from .operators.pairs import ordering_accuracy

__all__ = ["error_decomposition", "reference_blind", "escalate_once", "ordering_accuracy"]
__version__ = "0.1.0"
