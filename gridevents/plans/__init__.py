"""User-level analyses composed of the operators."""
