"""Importing this module fills the registry."""

from parcelflow.queries import alerts, comparables, feed, history, ingest, market, product, resolve, stream  # noqa: F401
