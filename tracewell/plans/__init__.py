"""Queries, and what plans share."""
