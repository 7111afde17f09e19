"""Relational operators: catalog preparation, title vectors, neighbours, co-view."""
