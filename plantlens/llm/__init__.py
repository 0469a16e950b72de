"""Training-data pipeline operators (licence scan, dedup, extraction, ...).

Nothing else in the library imports this subpackage; its queries are added by
``__spark_entry__.py`` when it is present.
"""
