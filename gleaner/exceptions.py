"""Errors of the engine."""


class GleanerError(Exception):
    """Any error that the command line reports instead of failing with a trace."""


class IngestionError(GleanerError):
    """A document can't be read."""


class AnalysisError(GleanerError):
    """An analysis failed."""


class ConfigurationError(GleanerError):
    """A setting is out of its domain."""


class IndexingError(GleanerError):
    """The corpus can't be written."""


class CorruptIndexError(GleanerError):
    """The corpus exists but can't be used."""
