"""Exceptions of the engine."""


class StreamError(Exception):
    """Base of all errors raised by the engine."""


class ConfigError(StreamError):
    """A job, function or option that doesn't exist or doesn't fit."""


class ConnectorUnavailable(StreamError):
    """A connector whose client is not installed."""


class GraphError(StreamError):
    """A job graph that is not valid."""


class StateError(StreamError):
    """Keyed state used without a key, or a transaction used out of order."""
