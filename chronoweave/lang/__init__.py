"""The text front end: a small statically checked language over frames."""

from .interpreter import Session

__all__ = ["Session"]
