"""Reusable column expressions (built-in Spark functions only)."""

from .numeric import ratio, sigmoid, softplus
from .text import (NUMBER_PATTERN, PY_STRIP_PATTERN, literal_guard_pattern,
                   pystrip, replace_sequential, replace_terms_fold,
                   replace_terms_guarded)

__all__ = [
    "NUMBER_PATTERN", "PY_STRIP_PATTERN", "literal_guard_pattern", "pystrip", "ratio", "replace_sequential", "replace_terms_fold",
    "replace_terms_guarded", "sigmoid", "softplus",
]
