"""Named analytic reports: ``REGISTRY[key](tables) -> DataFrame``."""

from vendora.plans import audits, customers, delivery, explore, monthly, revenue, sellers, validation  # noqa: F401
from vendora.plans.common import ORACLE, REGISTRY  # noqa: F401
