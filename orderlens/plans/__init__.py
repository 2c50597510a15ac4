"""Reports and documents composed from the operators."""
