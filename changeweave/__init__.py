"""A PySpark engine for change streams: changelogs in, current state, guarded upserts, queues and certificates out."""
