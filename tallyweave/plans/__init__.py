"""Survey-shaped views over the star schema and the query catalogue."""
