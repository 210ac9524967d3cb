"""Streaming over the session's own event log. An extension: the dialect itself has no streaming operators."""
