"""Building blocks used by the operators."""
