"""Typed errors of the verbs."""


class QuarryError(Exception):
    """Base of all errors raised by verbs."""


class InvalidArgument(QuarryError, ValueError):
    """A parameter out of its domain."""


class InvalidFilter(QuarryError, ValueError):
    """A predicate outside the closed grammar."""


class WriteRejected(QuarryError, ValueError):
    """A batch that fails validation; nothing of it was written."""


class IllegalTransition(QuarryError, ValueError):
    """A lifecycle change that the state machine doesn't have."""


class UnknownCollection(QuarryError, KeyError):
    """An operational collection that isn't registered."""


class ProjectionRejected(QuarryError, ValueError):
    """A projection declaration that can't be accepted."""


class ExtractionFailed(QuarryError, RuntimeError):
    """An external provider that broke its protocol."""


class DenseDisabled(QuarryError, RuntimeError):
    """Vector search refused because the embedder isn't equivalent to the one that indexed."""
