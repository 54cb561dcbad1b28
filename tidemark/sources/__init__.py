"""Sources, sinks and their configuration."""
