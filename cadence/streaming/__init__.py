"""Streaming: intentionally empty.

The reference has no streaming operator (no watermarks, event-time windows or
state), so none is built here. The scoring operators are stateless or
account-local DataFrame functions; a ``writeStream.foreachBatch`` job can call
them on each micro-batch unchanged.
"""
