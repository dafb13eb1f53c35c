"""Incremental runs of the batch models.

The reference is batch-only (sessions come from a session id carried by the
event, not from time gaps), so there are no watermarks or stateful
operators to build. What streams is the *input*: new ``event_date``
partitions landing in the raw folder. ``stage_incrementally`` stages only
files not seen before, with exactly-once bookkeeping in a checkpoint.
"""

from funnelworks.streaming.staging import stage_incrementally

__all__ = ["stage_incrementally"]
