"""Content-integrity analytics on Spark: hashing, manifests, caches, snapshots
and the record-level operators of a large data pipeline, as DataFrame plans."""

__version__ = "0.1.0"
