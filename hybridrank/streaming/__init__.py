"""Arrival-time stateful operators, with batch twins."""
