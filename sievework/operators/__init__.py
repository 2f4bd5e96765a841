"""Operators: every public function takes DataFrames and returns a DataFrame."""
