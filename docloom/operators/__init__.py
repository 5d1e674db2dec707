"""Operators on whole tables: graphs as node and edge rows."""
