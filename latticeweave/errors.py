"""Errors of the engine, each with a code."""

from __future__ import annotations

from enum import IntEnum


class ErrorCode(IntEnum):
    NONE = 0
    NOT_INITIALIZED = 1
    FILE_OPEN = 2
    FILE_READ = 3
    FILE_WRITE = 4


class LatticeError(RuntimeError):
    """Base of all errors that the engine raises for what lies outside it; wrong arguments are ValueError, TypeError or KeyError."""

    code = ErrorCode.NONE


class NotInitializedError(LatticeError):
    """No active Spark session."""

    code = ErrorCode.NOT_INITIALIZED


class InputOutputError(LatticeError):
    def __init__(self, path: str, message: str):
        super().__init__(f"{path}: {message}")
        self.path = path


class FileOpenError(InputOutputError):
    code = ErrorCode.FILE_OPEN


class FileReadError(InputOutputError):
    code = ErrorCode.FILE_READ


class FileWriteError(InputOutputError):
    code = ErrorCode.FILE_WRITE


def captured(call, *args, **options) -> tuple[object | None, LatticeError | None]:
    """Result and error of a call: one of them is None. Errors of other kinds pass."""
    try:
        return call(*args, **options), None
    except LatticeError as e:
        return None, e


def code_of(error: LatticeError | None) -> ErrorCode:
    return ErrorCode.NONE if error is None else error.code


def active_session():
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    if session is None:
        raise NotInitializedError("no active Spark session")
    return session
