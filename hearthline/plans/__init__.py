"""End-to-end computations composed from the operators."""
