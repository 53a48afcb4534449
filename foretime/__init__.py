"""Point-in-time analytics on PySpark: every feature is knowable strictly before the row it describes."""
