"""All checked queries."""

from . import q_audit, q_content, q_end, q_packages, q_repos, q_sources, q_streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
