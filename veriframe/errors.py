"""Errors of strict reads. Permissive reads report the same problems as rows of a `bad_record` column instead."""


class IngestError(Exception):
    """A data set that can't be read."""


class MissingAssetError(IngestError):
    """A file or directory that a data set needs is not there."""


class CorruptAnnotationError(IngestError):
    """An annotation file that can't be parsed."""


class BadImageHeaderError(IngestError):
    """Bytes that are no image."""


class IntegrityError(Exception):
    """An artifact whose digest isn't the pinned one."""
