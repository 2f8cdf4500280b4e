"""Functions of the freight-rate analytics library."""
