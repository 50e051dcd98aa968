"""furlong: racing analytics as PySpark DataFrame operators."""
