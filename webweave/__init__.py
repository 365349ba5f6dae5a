"""Backlink, web-text and link-graph analytics as Spark jobs."""

from webweave.session import local_session, materialize

__all__ = ["local_session", "materialize"]
