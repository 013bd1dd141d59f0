"""labelforge.operators."""
