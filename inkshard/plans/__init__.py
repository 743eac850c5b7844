"""Every named query; importing the modules registers them."""

from inkshard.plans import conversion_log, documents, markup, packages, scalars, streams, structure  # noqa: F401
from inkshard.plans.registry import PLANS

__all__ = ["PLANS"]
