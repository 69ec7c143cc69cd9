"""What can end a run, as typed errors with the facts and the exit code of each."""

from __future__ import annotations


class BusframeError(Exception):
    """Base of all errors here. facts: names and values that tell where and why."""

    exit_code = 1

    def __init__(self, message: str, **facts):
        super().__init__(message)
        self.facts = facts


class RecordingMissing(BusframeError):
    pass


class RecordingEmpty(BusframeError):
    pass


class RecordingUnreadable(BusframeError):
    pass


class NoRecords(BusframeError):
    exit_code = 2


class FillerRecording(BusframeError):
    """Records that all look the same, as padding does."""

    exit_code = 2


class ClockMismatch(BusframeError):
    """The clock's format is unclear, or another one than was asked for. Strict mode only."""

    exit_code = 2


class FirstRecordCut(BusframeError):
    pass


class BadWordCount(BusframeError):
    pass


class UnknownType(BusframeError):
    pass


class RecordCut(BusframeError):
    pass


class BadRecord(BusframeError):
    """A clock out of range, or a record that breaks a structural rule. Strict mode only."""


class UnknownErrorCode(BusframeError):
    pass


class SyncLost(BusframeError):
    """No record was found again behind a corrupt place. The rows before it are good."""

    exit_code = 3


class NotMonotonic(BusframeError):
    """A recording steps backward in a merge. Strict mode only."""


class IncompatibleInputs(BusframeError, ValueError):
    """A recording without an absolute clock can't be merged."""

    exit_code = 6


class OutputIsInput(BusframeError, ValueError):
    pass


class OutputExists(BusframeError, FileExistsError):
    pass


class WriteFailed(BusframeError):
    pass


class BadUsage(BusframeError, ValueError):
    exit_code = 4


class BadConfiguration(BusframeError, ValueError):
    exit_code = 5


#: The error of each outcome of a recording (see sources/recording.py); others are good ends.
OUTCOMES = {
    "OPEN_MISSING": RecordingMissing, "OPEN_EMPTY": RecordingEmpty, "OPEN_ERROR": RecordingUnreadable, "NO_RECORDS": NoRecords, "HOMOGENEOUS": FillerRecording, "UNRECOVERABLE": SyncLost,
    "STRICT_CLOCK": ClockMismatch, "STRICT_FIRST_TRUNCATED": FirstRecordCut, "STRICT_WORD_COUNT": BadWordCount, "STRICT_UNKNOWN_TYPE": UnknownType, "STRICT_TRUNCATED": RecordCut,
}


def of_outcome(path: str, outcome: str, **facts) -> BusframeError | None:
    """The error that an outcome is, or null if the recording ended well."""
    kind = OUTCOMES.get(outcome, BadRecord if outcome.startswith("STRICT_") else None)
    told = ", ".join(f"{k} {v}" for k, v in facts.items() if v is not None)
    return kind(f"{path}: {outcome.lower().replace('_', ' ')}" + f" ({told})" * bool(told), path=path, outcome=outcome, **facts) if kind else None
