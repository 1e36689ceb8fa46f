"""Evidence and table analytics as PySpark DataFrame operators."""
