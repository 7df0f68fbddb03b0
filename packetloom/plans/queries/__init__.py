"""Queries over the driver's tables, one per operator or more."""

from packetloom.plans.queries import evaluation, models, preparation
from packetloom.plans.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "models", "preparation"]
