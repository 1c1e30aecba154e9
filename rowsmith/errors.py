"""What reading and writing can raise."""


class RowsmithError(Exception):
    """Root of all errors of this package."""


class HeaderSizeMismatch(RowsmithError):
    """Given headers, or a row under `missing_headers="raise"`, have another width than the header."""


class IncorrectOption(RowsmithError):
    """Options that contradict each other or the input."""


class ValidationError(RowsmithError):
    """One or more invalid options, all listed."""


class DuplicateHeaders(RowsmithError):
    def __init__(self, message: str, headers: list[str] | None = None) -> None:
        super().__init__(message)
        self.headers = headers or []


class MissingKeys(RowsmithError):
    def __init__(self, message: str, keys: list[str] | None = None) -> None:
        super().__init__(message)
        self.keys = keys or []


class EmptyFileError(RowsmithError):
    """No header line."""


class NoColSepDetected(RowsmithError):
    """No candidate separator occurs where one must."""


class KeyMappingError(RowsmithError):
    """A mapped header is not there."""


class MalformedCSV(RowsmithError):
    """A quoted field never closes."""


class FieldSizeLimitExceeded(RowsmithError):
    """A field has more bytes than `field_size_limit`."""


class InvalidInputData(RowsmithError):
    """The writer was given something that is no row."""


class TooManyBadRows(RowsmithError):
    """More bad rows than `bad_row_limit`."""
