"""Whole plans: the check of a code base, signature generation, and the operators over the driver tables."""
