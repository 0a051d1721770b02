"""Event analytics as PySpark DataFrame operators.

Every table or stream is first brought into one event frame
(`event_id, name, value, tag, additional_info, timestamp`, see `model.py`).
`operators` filter, aggregate and shape event frames, `sources` read and write
them, `plans` runs declarative views, and `streaming` holds the Structured
Streaming versions.
"""
