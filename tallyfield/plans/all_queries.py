"""Importing this module registers every query."""

from . import domain, health, identity, ingest, landing, learning, portfolio, relational, signals, stateful, windows  # noqa: F401
