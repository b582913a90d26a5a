"""Maps from one embedding space to another."""
