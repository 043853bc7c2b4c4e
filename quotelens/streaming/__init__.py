"""Live monitors over attempt streams."""
