"""Named scalar functions, codecs and the protocols of user functions."""
