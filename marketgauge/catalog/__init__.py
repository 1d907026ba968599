"""Named queries over a data folder, each with the SQL that checks it."""

from . import cleaning, evaluation, exploring, features, history, modelling, sampling, statistics
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "evaluation", "exploring", "features", "history",
           "modelling", "sampling", "statistics"]
