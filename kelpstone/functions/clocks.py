"""Hybrid clock values and injectable clocks."""

from __future__ import annotations

import time

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(physical: Column, logical: Column) -> Column:
    """48 bits of physical time over 16 of logical; for physical times below 2**47."""
    return F.shiftleft(physical.cast("long"), 16).bitwiseOR(logical.cast("long"))


def physical(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 16)


def logical(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")


class PhysicalClock:
    def now(self) -> int:
        """Microseconds since the epoch."""
        return time.time_ns() // 1000

    def sleep(self, micros: int) -> None:
        time.sleep(micros / 1e6)


class FakeClock:
    def __init__(self, start: int = 0):
        self.at = start

    def now(self) -> int:
        return self.at

    def sleep(self, micros: int) -> None:
        self.at += micros

    advance = sleep
