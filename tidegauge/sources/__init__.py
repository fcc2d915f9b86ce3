"""Reading, writing and making series."""
