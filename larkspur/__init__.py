"""larkspur: code-intelligence analytics expressed as PySpark DataFrame plans."""
