"""Exceptions of the engine. Corruption is reported, never retried or repaired."""


class EngineError(Exception):
    """Base of every error the engine raises itself."""


class CorruptionError(EngineError):
    """Bytes that can't be what a writer wrote."""

    def __init__(self, message: str, offset: int | None = None, expected=None, actual=None):
        super().__init__(message if offset is None else f"{message} at offset {offset}: expected {expected}, found {actual}")
        self.offset, self.expected, self.actual = offset, expected, actual


class StorageError(EngineError):
    """A file system operation failed."""


class EngineStateError(EngineError):
    """The operation isn't allowed in the store's present state."""
