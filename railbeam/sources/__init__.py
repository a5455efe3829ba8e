"""Feeds in, tables in and out."""
