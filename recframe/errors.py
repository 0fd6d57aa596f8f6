"""Refusals, one class for each reason. All are raised before anything is written."""


class RecordError(ValueError):
    """The base of all refusals."""


class SpecError(RecordError):
    """A boundary, an option or a combination of options that makes no sense."""


class NotSeekable(RecordError):
    """The file has no seek table at its end."""


class NoFrames(RecordError):
    """The seek table lists no frame."""


class NoRecords(RecordError):
    """The boundary ends no record in frame 0, so indices have no meaning."""


class PastEnd(RecordError):
    """The first record asked for lies past the end of the file."""


class NoSeparator(RecordError):
    """A skip asked for more whole records than the frame holds."""


class IncompleteFinal(RecordError):
    """Bytes after the last record, under a boundary that has no such thing as an unterminated record."""


class IncompleteFrame(RecordError):
    """A record that goes on past the end of a frame that isn't the last."""


class Uneven(RecordError):
    """A frame that doesn't hold as many records as the others."""


class Refused(RecordError):
    """An edit that would break the layout."""


class Locked(RecordError):
    """Another writer holds the file, or left its lock behind."""
