"""Grids over time stamps in ticks of a rational time base, exact in integers."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Targets start + phase + k / rate seconds, k from 0, over ticks of time_base seconds.

    The last target at or before a tick is k = floor((scale * (tick - start) - shift) / step): three integers for a whole table.
    """

    scale: int
    shift: int
    step: int

    @classmethod
    def of(cls, time_base: Fraction, phase: Fraction, rate: Fraction) -> Grid:
        time_base, phase, rate = Fraction(time_base), Fraction(phase), Fraction(rate)
        if time_base <= 0 or phase < 0 or rate <= 0:
            raise ValueError("a grid has a positive time base and rate, and no negative phase")
        a, b = time_base * rate, phase * rate
        whole = a.denominator * b.denominator
        return cls(a.numerator * b.denominator, b.numerator * a.denominator, whole)

    def reached(self, tick, start):
        """k of the last target at or before tick (negative before the first), of ints, arrays or Columns."""
        at = (tick - start) * self.scale - self.shift
        if isinstance(at, Column):
            return F.call_function("div", at - F.pmod(at, F.lit(self.step)), F.lit(self.step)).cast("long")
        return at // self.step


def seconds(ticks: Column, time_base: Fraction) -> Column:
    """Ticks as seconds, one rounding only where ticks * numerator is below 2^53."""
    return (ticks * time_base.numerator).cast("double") / float(time_base.denominator)
