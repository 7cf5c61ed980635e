"""Daily risk signals from raw blockchain tables, as Spark DataFrame plans."""
