"""Errors and the exit code of each, for programs that wrap the library."""

from __future__ import annotations


class FeldsparError(Exception):
    """Any failure of the library."""

    exit_code = 1


class InvalidGraph(FeldsparError):
    """A document that breaks integrity rules."""


class NoIndex(FeldsparError):
    """No state folder here or above."""

    exit_code = 2


class NotFound(FeldsparError):
    """No record of that name."""

    exit_code = 3


class BadArgument(FeldsparError):
    """An argument that can't be read, such as a line reference."""

    exit_code = 4
