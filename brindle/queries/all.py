"""Importing this module registers every query."""

from brindle.queries import browse, evidence, keeping, more, people, retrieval, signing, syncing, upkeep, watching  # noqa: F401
from brindle.queries.registry import ORACLE_SQL, QUERIES  # noqa: F401
