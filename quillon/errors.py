"""Exceptions of the engine."""


class QuillonError(Exception):
    """Base of all errors raised here; Spark's own run-time errors pass through."""


class ParseError(QuillonError):
    pass


class ValidationError(QuillonError):
    """A statement that cannot be planned: unknown names, wrong arity, forbidden shapes."""


class ConstraintError(QuillonError):
    """A mutation that breaks NOT NULL, a key, a check, a foreign key or a type's bounds."""


class TransactionError(QuillonError):
    pass
