"""Errors of the key-value log."""


class KeyLakeError(Exception):
    """The base of all errors here."""


class KeyNotFound(KeyLakeError):
    """The key has no live value."""


class EmptyKey(KeyLakeError):
    """A row has a null or empty key."""


class TxnTooBig(KeyLakeError):
    """A batch has too many rows or bytes."""


class InvalidRequest(KeyLakeError):
    """A parameter is out of its range."""


class NoRewrite(KeyLakeError):
    """No value-log file is worth a rewrite."""
