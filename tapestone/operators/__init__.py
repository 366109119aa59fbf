"""Event, outcome, group and report operators."""
