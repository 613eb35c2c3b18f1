"""End-to-end flows and the query catalog."""
