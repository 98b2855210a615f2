"""Errors that callers may want to tell apart."""


class DocquillError(Exception):
    """Any error of this package."""


class InvalidQuery(DocquillError):
    """A filter, option, pipeline or statement that can't be understood."""


class InvalidUpdate(DocquillError):
    """An update that can't be applied to the rows it matches."""


class UniqueViolation(DocquillError):
    """A write that would repeat a value of a unique index."""


class TransactionConflict(DocquillError):
    """A commit whose rows were changed by someone else since they were read."""


class TokenTooOld(DocquillError):
    """A resume token before the oldest change that is still kept."""


class Aborted(DocquillError):
    """A procedure that ended in an abort step."""
