"""The built-in rules, in the order their findings are listed."""

from . import custom, governance, performance, quality, security
from .base import Check, Rule, failed, passed

BUILT_IN = quality.RULES + performance.RULES + security.RULES + governance.RULES

__all__ = ["BUILT_IN", "Check", "Rule", "custom", "failed", "passed"]
