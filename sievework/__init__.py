"""Feature ranking and ranking evaluation as plain PySpark DataFrame operators."""
