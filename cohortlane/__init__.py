"""Clinical cohort feasibility studies as plain Spark DataFrame plans."""
