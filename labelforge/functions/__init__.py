"""labelforge.functions."""
