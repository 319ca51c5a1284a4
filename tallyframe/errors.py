"""Errors a caller can catch."""


class ReconError(Exception):
    """Base of all errors of this package."""


class ConfigurationError(ReconError):
    """The configuration cannot be read or has wrong types."""


class FileAccessError(ReconError):
    """A named input does not exist or cannot be opened."""


class ParserError(ReconError):
    """A file cannot be read as its source."""


class SchemaMismatchError(ParserError):
    """A mandatory column cannot be found among the headers."""
