"""Errors that callers may want to tell apart."""


class InvalidPeriod(ValueError):
    """A period that ends before it starts, or that can't be read."""


class ViewRecordError(ValueError):
    """A view that can't be recorded."""
