"""No streaming operators.

The workload this library covers has no streams, watermarks or time windows.
Its one incremental idea, writing a snapshot only when the content changed,
is a batch sink: see ``tallystone.sources.snapshots``.
"""
