"""The one exception type raised for bad arguments or unusable data."""


class TabularError(Exception):
    """A problem the caller can fix; ``code`` is stable, ``message`` is for people."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code
        self.message = message
