"""Queries over the driver tables, each paired with an oracle SQL text where SQL can say it."""
