"""Data model and the demonstration graph over the driver's tables."""
