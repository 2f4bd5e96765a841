"""End-to-end studies composed from the operators."""
