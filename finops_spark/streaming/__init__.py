"""Streaming forms of the feed monitor and of batch scoring."""
