"""Keyed state, timers, exactly-once sinks and running unbounded queries."""
