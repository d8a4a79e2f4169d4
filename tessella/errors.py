"""Errors raised while a plan is built."""


class CompilationError(ValueError):
    """A program that can't be planned; the message names the program and the reason."""
