"""The graph questions, each one Catalyst plan."""
