"""Extension: facts from streams (the engine's own operators are all batch)."""
