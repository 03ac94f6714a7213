"""Registered queries, one module per operator family.

Importing this package fills :mod:`evweave.registry`.
"""

from . import hist_q, metrics_q, model_q, profile_q, resample_q, select_q, split_q, sweep_q  # noqa: F401
