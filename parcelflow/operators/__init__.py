"""Reusable DataFrame operators: order statistics, nearest neighbours, clustering, lag."""
