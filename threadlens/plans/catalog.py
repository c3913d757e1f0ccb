"""All registered queries (importing the modules fills the registry)."""

from threadlens.plans import q_io, q_items, q_models, q_text  # noqa: F401
from threadlens.plans.registry import ORACLE, QUERIES  # noqa: F401
