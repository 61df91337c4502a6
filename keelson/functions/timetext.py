"""Times that texts show, found by reading tokens: runs of digits, words, and single signs.

A text is cut into tokens once; each number is then judged by its neighbours, in array expressions that stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: phrases by which a question asks for a time, and what it then asks for; the first that occurs counts
PHRASES = {"what time of day": "qualitative", "what time of the day": "qualitative", "how long": "duration", "how much time": "duration", "how many minutes": "duration", "how many seconds": "duration", "what time": "clock"}
#: fixed values: names of units, and the name that keys have
UNITS = {
    "sec": "second", "secs": "second", "second": "second", "seconds": "second", "min": "minute", "mins": "minute", "minute": "minute", "minutes": "minute", "hr": "hour", "hrs": "hour", "hour": "hour", "hours": "hour",
    "day": "day", "days": "day", "week": "week", "weeks": "week", "month": "month", "months": "month", "year": "year", "years": "year",
}
#: fixed value: signs of prices
CURRENCIES = "$€£"
FIELDS = "array<struct<key:string,kind:string,shown:string,ambiguous:boolean>>"


def question_mode(question: Column) -> Column:
    """What a question about time asks for: qualitative, duration or clock; null for others."""
    said = F.lower(question)
    out = F.lit(None).cast("string")
    for phrase, mode in reversed(PHRASES.items()):
        out = F.when(said.contains(phrase), mode).otherwise(out)
    return out


def _tokens(text: Column) -> Column:
    """Structs of a text's tokens: low (in lower case), kind (digit, word or the sign itself), n (its length), glued (no space before it), raw (with the space before it)."""
    plain = F.replace(text, F.lit("："), F.lit(":"))
    token = F.lit(r"(?s)\s*([0-9]+|[\p{L}\p{M}_]+|.)")
    kind = lambda t: F.when(t.rlike("^[0-9]"), "digit").when(t.rlike(r"^[\p{L}\p{M}_]"), "word").otherwise(t)
    return F.zip_with(
        F.regexp_extract_all(plain, token, F.lit(1)), F.regexp_extract_all(plain, token, F.lit(0)), lambda t, raw: F.struct(F.lower(t).alias("low"), kind(t).alias("kind"), F.char_length(t).alias("n"), (t == raw).alias("glued"), raw.alias("raw"))
    )


class _Reader:
    """Conditions on the tokens around a place, counted from 0; places beyond the text have no token."""

    def __init__(self, tokens: Column):
        self.t = tokens

    def of(self, i: Column, part: str) -> Column:
        return F.get(self.t, i)[part]

    def kind(self, i: Column, *kinds: str) -> Column:
        return F.coalesce(self.of(i, "kind").isin(*kinds), F.lit(False))

    def glued(self, i: Column, *kinds: str) -> Column:
        """A token of these kinds with no space before it."""
        return self.kind(i, *kinds) & F.coalesce(self.of(i, "glued"), F.lit(False))

    def low(self, i: Column, *words: str) -> Column:
        return F.coalesce(self.of(i, "low").isin(*words), F.lit(False))

    def digits(self, i: Column, least: int, most: int) -> Column:
        return self.kind(i, "digit") & self.of(i, "n").between(least, most)

    def value(self, i: Column) -> Column:
        return self.of(i, "low").cast("int")

    def begins(self, i: Column) -> Column:
        """The number at i isn't the rest of a longer one."""
        return ~(F.coalesce(self.of(i, "glued"), F.lit(False)) & self.kind(i - 1, ":", "."))

    def priced(self, i: Column) -> Column:
        return self.kind(i - 1, *CURRENCIES)

    def half(self, i: Column) -> Column:
        """Tokens from i that say the half of the day; 0 if they don't. With halves() only."""
        return F.coalesce(self.of(i, "half"), F.lit(0))

    def halves(self) -> Column:
        """The tokens, each with how many from it say the half of the day: looked at many times, so found once."""
        return F.transform(self.t, lambda x, i: F.struct(*(x[c].alias(c) for c in ("low", "kind", "n", "glued", "raw")), F.when(self.low(i, "am", "pm", "a", "p"), self._half(i)).otherwise(0).alias("half")))

    def _half(self, i: Column) -> Column:
        """am, a.m or a.m. (likewise pm)."""
        short = F.when(self.low(i, "am", "pm"), 1).when(self.low(i, "a", "p") & self.glued(i + 1, ".") & self.glued(i + 2, "word") & self.low(i + 2, "m"), 3).otherwise(0)
        long = F.when((short > 0) & self.glued(i + short, ".") & ~self.glued(i + short + 1, "digit", "word"), short + 1).otherwise(short)
        return F.when(self.glued(i + long, "digit", "word"), 0).otherwise(long)

    def free(self, i: Column) -> Column:
        """A time may end before i."""
        return ~self.glued(i, "digit", ":", ".")

    def shown(self, i: Column, n: Column) -> Column:
        return F.trim(F.array_join(F.transform(F.slice(self.t, i + 1, n), lambda x: x["raw"]), ""))


def _clocks(r: _Reader, size: Column) -> Column:
    """Structs (at, n, seconds, half) of numbers that are followed by a sign and two digits, first come, first served; half: how many tokens say it."""

    def read(i: Column) -> Column:
        full = r.kind(i + 3, ":") & r.digits(i + 4, 2, 2)
        out = F.lit(None)
        for seconds in (False, True):  # the longest form that ends well counts
            end = i + (5 if seconds else 3)
            half = r.half(end)
            for with_half in (False, True):
                n = end - i + (half if with_half else F.lit(0))
                fits = r.free(i + n) & (full if seconds else F.lit(True)) & ((half > 0) if with_half else F.lit(True))
                out = F.when(fits, F.struct(i.alias("at"), n.alias("n"), F.lit(seconds).alias("seconds"), (half if with_half else F.lit(0)).alias("half"))).otherwise(out)
        return F.when(r.digits(i, 1, 2) & r.begins(i) & r.kind(i + 1, ":", ".") & r.digits(i + 2, 2, 2), out)

    found = F.filter(F.transform(F.sequence(F.lit(0), size - 1), read), lambda x: x.isNotNull())
    start = F.struct(F.lit(0).alias("from"), F.array().cast("array<struct<at:int,n:int,seconds:boolean,half:int>>").alias("kept"))
    take = lambda s, x: F.when(x["at"] >= s["from"], F.struct((x["at"] + x["n"]).alias("from"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s)
    return F.aggregate(found, start, take)["kept"]


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _period(r: _Reader, at: Column) -> Column:
    return F.concat(F.substring(r.of(at, "low"), 1, 1), F.lit("m"))


def _clock_fields(r: _Reader, clocks: Column, mode: Column) -> Column:
    def field(c: Column) -> Column:
        at, end = c["at"], c["at"] + F.when(c["seconds"], 5).otherwise(3)
        point = r.kind(at + 1, ".")
        valid = ((r.value(at) <= 23) | (mode == "duration")) & ((c["half"] == 0) | r.value(at).between(1, 12)) & (r.value(at + 2) < 60) & (~c["seconds"] | (r.value(at + 4) < 60)) & ~r.priced(at)
        valid &= (mode == "clock") | (~point & (c["half"] == 0))
        key = F.concat_ws(":", F.lit("time"), _two(r.value(at)), _two(r.value(at + 2)), F.when(c["seconds"], _two(r.value(at + 4))), F.when(c["half"] > 0, _period(r, end)).otherwise("?"))
        return F.when(valid, F.struct(key.alias("key"), F.lit("numeric_time").alias("kind"), r.shown(at, c["n"]).alias("shown"), (point & (c["half"] == 0)).alias("ambiguous"), at.alias("at"), c["n"].alias("n")))

    return F.filter(F.transform(clocks, field), lambda x: x.isNotNull())


def _hour_fields(r: _Reader, size: Column, taken: Column) -> Column:
    """Hours with their half of the day, where no clock time is."""

    def field(i: Column) -> Column:
        half = r.half(i + 1)
        inside = F.exists(taken, lambda c: (c["at"] <= i + half) & (i < c["at"] + c["n"]))
        valid = r.digits(i, 1, 2) & r.begins(i) & (half > 0) & r.value(i).between(1, 12) & ~r.priced(i) & ~inside
        return F.when(valid, F.struct(F.concat(F.lit("time:"), _two(r.value(i)), F.lit(":?:"), _period(r, i + 1)).alias("key"), F.lit("hour_period").alias("kind"), r.shown(i, half + 1).alias("shown"), F.lit(False).alias("ambiguous")))

    return F.filter(F.transform(F.sequence(F.lit(0), size - 1), field), lambda x: x.isNotNull())


def _span_fields(r: _Reader, size: Column) -> Column:
    units = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))

    def field(i: Column) -> Column:
        part = r.glued(i + 1, ".") & r.glued(i + 2, "digit")
        unit = i + F.when(part, 3).otherwise(1)
        number = F.concat(r.of(i, "low"), F.when(part, F.concat(F.lit("."), r.of(i + 2, "low"))).otherwise(""))
        valid = r.kind(i, "digit") & r.begins(i) & r.low(unit, *UNITS) & ~r.glued(unit + 1, "digit")
        key = F.concat(F.lit("duration:"), number, F.lit(":"), F.try_element_at(units, r.of(unit, "low")))
        return F.when(valid, F.struct(key.alias("key"), F.lit("duration_unit").alias("kind"), r.shown(i, unit - i + 1).alias("shown"), F.lit(False).alias("ambiguous")))

    return F.filter(F.transform(F.sequence(F.lit(0), size - 1), field), lambda x: x.isNotNull())


def time_fields(text: Column, mode: Column) -> Column:
    """Times that a text shows, for a question of this mode: key (time:HH:MM[:SS]:am|pm|?, or duration:n:unit), kind, as shown, and whether a point leaves it open.

    Nothing is filled in or corrected; times out of range, prices and, for durations, points and halves of the day are no times. A mode of qualitative or null has none.
    Clock times come first in their order, then hours or spans.
    """
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["key"], x["kind"], x["shown"], x["ambiguous"]))

    def read(tokens: Column) -> Column:
        r, size = _Reader(tokens), F.size(tokens)
        # bound once: each place of the text is looked at many times
        found = F.transform(F.array(_clock_fields(r, _clocks(r, size), mode)), lambda c: F.concat(plain(c), F.when(mode == "clock", plain(_hour_fields(r, size, c))).otherwise(plain(_span_fields(r, size)))))
        return F.get(found, F.lit(0))

    none = F.array().cast(FIELDS)
    bound = F.get(F.transform(F.transform(F.array(_tokens(text)), lambda t: _Reader(t).halves()), read), F.lit(0))
    return F.when(text.rlike("[0-9]") & mode.isin("clock", "duration"), bound.cast(FIELDS)).otherwise(none)


def region_times(regions: Column, mode: Column, least: float = 0.5) -> Column:
    """Times of regions (structs of text and score), with the region's place and score; regions below the least score are left out, and a score that isn't within 0 and 1 is an error."""
    good = lambda x: F.coalesce((x["score"] >= 0) & (x["score"] <= 1), F.lit(False))
    told = lambda x, i: F.transform(time_fields(x["text"], mode), lambda f: F.struct(i.alias("region"), x["score"].alias("score"), f["key"].alias("key"), f["kind"].alias("kind"), f["shown"].alias("shown"), f["ambiguous"].alias("ambiguous")))
    kept = F.transform(regions, lambda x, i: F.when(~good(x), F.raise_error(F.lit("a score is not within 0 and 1")).cast("array<struct<region:int,score:double,key:string,kind:string,shown:string,ambiguous:boolean>>")).when(x["score"] >= least, told(x, i)).otherwise(F.array()))
    return F.flatten(kept)


def clock_key(text: Column) -> Column:
    """The key of the first clock time of a text; else null."""
    return F.get(time_fields(text, F.lit("clock")), F.lit(0))["key"]
