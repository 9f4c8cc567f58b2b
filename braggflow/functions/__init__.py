"""Column builders and driver-side constants for crystal geometry."""
