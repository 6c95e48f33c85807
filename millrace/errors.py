"""One exception for each way in which preparing a dataset can fail."""


class MillraceError(Exception):
    """Base of all errors that this library raises."""


class UnreadableFile(MillraceError):
    pass


class UnsupportedFormat(MillraceError):
    pass


class ParseFailure(MillraceError):
    pass


class MissingColumn(MillraceError):
    pass


class InvalidRecipe(MillraceError):
    pass


class ExpressionError(MillraceError):
    pass


class ProviderError(MillraceError):
    pass


class ExportFailure(MillraceError):
    pass
