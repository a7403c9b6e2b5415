"""Personal-data analytics on PySpark: find, classify, mask and restore personal data in text tables."""
