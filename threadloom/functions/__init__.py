"""See the package's modules."""
