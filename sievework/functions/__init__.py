"""Column helpers and distributed ordering shared by all operators."""
