"""Job graphs, chaining reports and declared jobs."""
