"""Streaming.

The source application has no streams: every query is a batch read of static
files (its "real-time" is a page caption). There are therefore no watermarks,
event-time windows or state here. ``clean_batches`` lets a file stream of raw
orders be cleaned per micro-batch with the batch operators, for users who
land raw files continuously.
"""

from funnelkit.streaming.batches import clean_batches

__all__ = ["clean_batches"]
