"""Message formats, structural checks and payloads, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from busframe.functions.words import MESSAGE_TYPES


def message_format(msg_type: Column, rt: Column, direction: Column, word_count: Column, ts: Column) -> Column:
    mode = (
        F.when((rt == 31) & (word_count >= ts + 3), "MODE_CODE_BCAST_DATA").when(rt == 31, "MODE_CODE_BCAST_NO_DATA")
        .when(word_count < ts + 4, "MODE_CODE_NO_DATA").when(direction == 1, "MODE_CODE_TX_DATA").otherwise("MODE_CODE_RX_DATA")
    )
    return F.when(msg_type == 0x02, "RECEIVE").when(msg_type == 0x04, "TRANSMIT").when(msg_type == 0x08, "RT_TO_RT").when(msg_type == 0x10, "RECEIVE_BROADCAST").when(msg_type == 0x18, "RT_TO_RT_BROADCAST").when(msg_type == 0x20, "SPURIOUS_DATA").when(msg_type == 0x01, mode)


def least_payload(fmt: Column, n: Column) -> Column:
    return F.when(fmt.isin("RECEIVE", "TRANSMIT"), n + 1).when(fmt == "RT_TO_RT", n + 3).when(fmt == "RECEIVE_BROADCAST", n).when(fmt == "RT_TO_RT_BROADCAST", n + 2).when(fmt.isin("MODE_CODE_TX_DATA", "MODE_CODE_RX_DATA"), 2).when(fmt.isin("MODE_CODE_NO_DATA", "MODE_CODE_BCAST_DATA"), 1).otherwise(0)


def reject_reason(fmt: Column, direction: Column, n: Column, word_count: Column, ts: Column) -> Column:
    """The first structural rule that a record breaks, or null."""
    return (
        F.when((fmt == "RECEIVE") & (direction == 1), "DIRECTION_NOT_RECEIVE").when((fmt == "TRANSMIT") & (direction == 0), "DIRECTION_NOT_TRANSMIT")
        .when((fmt != "SPURIOUS_DATA") & (word_count < ts + 2 + least_payload(fmt, n)), "CAPACITY")
    )


def late_reject_reason(fmt: Column, dir2: Column, n: Column, n2: Column) -> Column:
    """The rule that the second command of a transfer between terminals breaks, or null: it receives, as many words as are sent."""
    between = fmt.isin("RT_TO_RT", "RT_TO_RT_BROADCAST")
    return F.when(between & (dir2 == 1), "CMD2_DIRECTION").when(between & (n != n2), "CMD2_COUNT")


def status_word(w: Column) -> dict[str, Column]:
    """The terminal and the flag bits of a status word."""
    flag = lambda k: F.shiftright(w, k).bitwiseAND(1) == 1
    names = {"message_error": 10, "instrumentation": 9, "service_request": 8, "broadcast_received": 4, "busy": 3, "subsystem": 2, "dynamic_bus": 1, "terminal": 0}
    return {"rt": F.shiftright(w, 11).bitwiseAND(31)} | {k: flag(v) for k, v in names.items()}


def anomalies(status: Column, rt: Column, reserved: Column) -> Column:
    return F.array_compact(F.array(F.when(F.shiftright(status, 11).bitwiseAND(31) != rt, "STATUS_RT"), F.when(reserved, "RESERVED_BIT")))


def invalid_reason(t: dict[str, Column], msg_type: Column, word_count: Column, offset: Column, size: Column, least: int) -> Column:
    """The first check that a record at offset fails, or null."""
    return (
        F.when(offset + 2 > size, "UNREADABLE").when(~msg_type.isin(*MESSAGE_TYPES), "UNKNOWN_TYPE").when((word_count < least) | (word_count > 63), "WORD_COUNT")
        .when(offset + 2 * word_count > size, "TRUNCATED").when(t["hour"] >= 24, "HOUR").when(t["minute"] >= 60, "MINUTE").when(t["second"] >= 60, "SECOND")
        .when(t["micros"] > 999_999, "MICROS").when(~t["freerun"] & ((t["day"] < 1) | (t["day"] > 366)), "DAY")
    )


def payload(fmt: Column, w: Column, p: Column, n: Column) -> dict[str, Column]:
    """Status and data words of a record's words w, whose command stands before place p (from 0); short reads are null or empty."""
    words = lambda at: F.when(at + n <= F.size(w), F.slice(w, at + 1, n)).otherwise(F.array().cast("array<int>"))
    one = lambda at: F.when(at < F.size(w), F.slice(w, at + 1, 1)).otherwise(F.array().cast("array<int>"))
    status = F.when(fmt.isin("TRANSMIT", "MODE_CODE_TX_DATA", "MODE_CODE_NO_DATA"), F.get(w, p)).when(fmt == "RECEIVE", F.get(w, p + n)).when(fmt == "MODE_CODE_RX_DATA", F.get(w, p + 1)).when(fmt.isin("RT_TO_RT", "RT_TO_RT_BROADCAST"), F.get(w, p + 1))
    data = F.when(fmt.isin("RECEIVE", "RECEIVE_BROADCAST"), words(p)).when(fmt == "TRANSMIT", words(p + 1)).when(fmt.isin("RT_TO_RT", "RT_TO_RT_BROADCAST"), words(p + 2)).when(fmt.isin("MODE_CODE_RX_DATA", "MODE_CODE_BCAST_DATA"), one(p)).when(fmt == "MODE_CODE_TX_DATA", one(p + 1)).otherwise(F.array().cast("array<int>"))
    return {"status": status, "data_words": F.slice(data, 1, 32)}


def confidence(irig: Column, standard: Column) -> Column:
    most, margin = F.greatest(irig, standard), F.abs(irig - standard)
    return F.when((most < 4) | (margin < 3), "AMBIGUOUS").when((most >= 8) & (margin >= 6), "DECISIVE").otherwise("MARGINAL")
