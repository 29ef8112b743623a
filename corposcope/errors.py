"""Errors with machine-readable codes. The codes are fixed values."""
from __future__ import annotations


class EngineError(Exception):
    code = "TOOL_ERROR"
    client_fixable = False


class ConfigError(EngineError):
    code, client_fixable = "CONFIG_ERROR", True


class ToolError(EngineError):
    code, client_fixable = "TOOL_ERROR", True


class InvalidPattern(EngineError):
    code, client_fixable = "INVALID_PATTERN", True

    def __init__(self, why: str):
        super().__init__(f"Invalid regex pattern: {why}. Check the syntax or search with mode='fts'.")


class NoResults(EngineError):
    code, client_fixable = "NO_RESULTS", True


class SearchTimeout(EngineError):
    code = "TIMEOUT"


class Cancelled(EngineError):
    code = "CANCELLED"


class FileNotIndexed(EngineError):
    code, client_fixable = "FILE_NOT_FOUND", True


class MigrationFailed(EngineError):
    code = "MIGRATION_ERROR"


class Locked(EngineError):
    code = "DB_LOCKED"


class StaleIndex(EngineError):
    code = "INDEX_STALE"


class CorruptIndex(EngineError):
    code = "INDEX_CORRUPT"


class FileReadError(EngineError):
    code = "FILE_READ_ERROR"


class BinaryFile(EngineError):
    code = "BINARY_FILE"


class StorageError(EngineError):
    code = "IO_ERROR"


class JsonError(EngineError):
    code = "JSON_ERROR"


class PatternBuildError(EngineError):
    code = "REGEX_BUILD_ERROR"


class FileIndexError(EngineError):
    code = "FILE_INDEX_ERROR"


class HashError(EngineError):
    code = "HASH_ERROR"


class NgramError(EngineError):
    code = "TRIGRAM_ERROR"


class WalkError(EngineError):
    code = "WALK_ERROR"


class AccessDenied(EngineError):
    code, client_fixable = "ACCESS_DENIED", True
