"""rationale: PySpark jobs that explain the decisions of a black-box model for many rows at once."""
