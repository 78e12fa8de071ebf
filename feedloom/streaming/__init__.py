"""Structured Streaming forms of the feeds (ST1-ST4).

Sinks are written with ``foreachBatch`` into folders keyed by batch id and
overwritten as a whole, so a retried micro-batch replaces its own output
(idempotent); readers compact the change log. ``availableNow`` makes every
stream testable as a finite run.
"""
