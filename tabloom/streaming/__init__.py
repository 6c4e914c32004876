"""Streams: an extension, the batch engine has none of its own to match."""
