"""Queries on whole tables."""
