"""End-to-end dataflows composed from the operators."""
