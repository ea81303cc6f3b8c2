"""End-to-end plans, and the queries over the standard tables with their SQL."""
