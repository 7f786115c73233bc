"""Frames and the relational operators over them."""

from .frame import Frame

__all__ = ["Frame"]
