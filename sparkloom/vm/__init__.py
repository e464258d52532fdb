"""vm."""
