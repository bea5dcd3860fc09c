"""Layout and schedule analytics on PySpark: every operator is DataFrame -> DataFrame."""
