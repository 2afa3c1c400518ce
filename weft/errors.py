"""Errors. A missing node is a KeyError, a malformed structure a ValueError."""


class WeftError(Exception):
    """Base of what this package raises itself."""


class InvalidFormatError(WeftError, ValueError):
    """Text that is not of the format it should be."""


class PathNotAllowedError(WeftError, ValueError):
    """A path outside the allowed root."""


class LimitExceededError(WeftError, ValueError):
    """An input or result above a configured limit."""


class NodeNotFoundError(WeftError, KeyError):
    """A node id that the graph does not have."""

    def __str__(self) -> str:
        return f"node not found: {self.args[0]!r}"


class WeightError(WeftError, TypeError):
    """A node weight that is no number."""
