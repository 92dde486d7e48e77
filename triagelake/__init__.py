"""Content triage and training-data preparation as PySpark jobs."""
