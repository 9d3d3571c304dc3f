"""Part of the colloquy engine."""
