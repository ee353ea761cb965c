"""Errors that callers see; extraction problems of single files are data, not exceptions."""


class DocquarryError(Exception):
    pass


class IndexingError(DocquarryError):
    """The index can't be read or written."""


class ConflictError(IndexingError):
    """Another writer has published a version since the one that this change begins from."""


class SearchError(DocquarryError):
    """A query that can't be understood or run."""


class ExtractError(DocquarryError):
    """One file's content can't be read; ``kind`` is ``io``, ``unsupported`` or ``parse``."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind
