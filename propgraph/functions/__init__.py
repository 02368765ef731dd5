"""Functions on relations: statistics and sketches."""
