"""Imports every query module so that the registry is complete."""

from judgefuse.plans import q_assembly, q_em, q_eval, q_files, q_lr, q_scoring, q_sinks, q_spatial, q_sweep, q_trace, q_traj  # noqa: F401
from judgefuse.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
