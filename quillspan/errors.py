"""Errors of the engine. Failures of single rows become columns, not exceptions."""


class EngineError(Exception):
    """Base of all errors raised here."""


class InvalidDocumentNumber(EngineError, ValueError):
    """A document number that is missing, zero or negative."""


class MalformedFilename(EngineError, ValueError):
    """A file name without a document number."""


class InvalidRequest(EngineError, ValueError):
    """A question or setting outside its bounds."""
