"""What can go wrong, as exceptions on the driver and in functions."""


class EngineError(Exception):
    """Any failure of this engine."""


class FormatError(EngineError):
    """Bytes or text that are not what their format asks for."""


class UnsupportedError(EngineError):
    """A valid input that this engine does not handle."""


class ParseError(EngineError):
    """Text that cannot be read."""


class MismatchError(EngineError):
    """Two things that should agree and do not."""


class InvalidArgumentError(EngineError):
    """An option outside its range."""


class StorageError(EngineError):
    """A store that cannot be read or written."""


class InputOutputError(EngineError):
    """A path that cannot be read or written."""
