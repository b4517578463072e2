"""A PySpark engine for behavioural analytics over event logs and user properties."""
