"""Answer parsing, token sets and option rules, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .questions import option_structure, stripped, time_heading  # noqa: F401
from .timetext import clock_key, question_mode, time_fields  # noqa: F401


def parse_answer(text: Column, letters: str = "A-E") -> Column:
    """The letter of an answer of its own: X, X., (X), case-insensitive, with or without "Answer:" before; else null."""
    found = F.regexp_extract(F.trim(text), rf"^(?i:(?:answer\s*:\s*)?\(?([{letters}])\)?\.?)$", 1)
    return F.when(found != "", F.upper(found))


def strict_option(text: Column, letters: str = "A-D") -> Column:
    """The letter of an answer that is X, X. or (X), case-sensitive."""
    found = F.regexp_extract(F.trim(text), rf"^(?:([{letters}])\.?|\(([{letters}])\))$", 1)
    other = F.regexp_extract(F.trim(text), rf"^\(([{letters}])\)$", 1)
    return F.when(found != "", found).when(other != "", other)


def tokens(text: Column) -> Column:
    """Sorted distinct ASCII words and numbers, lower case."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are alike."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def edit_change(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length, 0 for two empty texts."""
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(n == 0, 0.0).otherwise(F.levenshtein(a, b) / n)


def literal_cover(group: Column, state: Column) -> Column:
    """Whether all tokens of a group are in a state."""
    return F.size(F.array_except(group, state)) == 0


def blank_option(option: Column) -> Column:
    """Blank, or only a heading of a stretch of time."""
    return (stripped(option) == "") | time_heading(option)


def expand_ranges(text: Column) -> Column:
    """1-3,5 as [1, 2, 3, 5]; a number said twice is an error."""
    part = lambda x: F.sequence(F.split(x, "-")[0].cast("int"), F.element_at(F.split(x, "-"), -1).cast("int"))
    out = F.flatten(F.transform(F.split(F.regexp_replace(text, r"\s", ""), ","), part))
    return F.when(F.size(out) == F.size(F.array_distinct(out)), out).otherwise(F.raise_error(F.concat(F.lit("a number twice in "), text)).cast("array<int>"))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two probability vectors over ln 2, within 0 and 1."""
    term = lambda x, m: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    return F.least(F.greatest(F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / F.ln(F.lit(2.0)), F.lit(0.0)), F.lit(1.0))


def logit_gain(option: Column, question: Column, eps: float = 2.0**-52) -> Column:
    """The positive part of the logit of option less that of question, both drawn in from 0 and 1 by eps."""
    logit = lambda x: F.ln(x) - F.log1p(-x)
    inside = lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1 - eps))
    return F.greatest(F.lit(0.0), logit(inside(option)) - logit(inside(question)))


def overlap_area(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    return F.get(F.transform(F.array(F.transform(logits, lambda x: F.exp(x - top))), lambda e: F.transform(e, lambda x: x / _sum(e))), F.lit(0))


def evidence_support(p: Column, q: Column, letters: int = 4) -> Column:
    """struct(value, mass, js) of a distribution over answers and the one of a blank: the mass of its letters times how much it differs. Both must be distributions of one length, or it is an error."""
    good = lambda x: F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0)) & (F.abs(_sum(x) - 1) <= 1e-7)
    kind = "struct<value:double,mass:double,js:double>"
    out = F.get(F.transform(F.array(F.struct(_sum(F.slice(p, 1, letters)).alias("mass"), js_divergence(p, q).alias("js"))), lambda s: F.struct((s["mass"] * s["js"]).alias("value"), s["mass"].alias("mass"), s["js"].alias("js"))), F.lit(0))
    return F.when(F.coalesce((F.size(p) == F.size(q)) & (F.size(p) > letters) & good(p) & good(q), F.lit(False)), out.cast(kind)).otherwise(F.raise_error(F.lit("not two distributions over the same answers")).cast(kind))


def logit_divergence(real: Column, blank: Column) -> Column:
    """Kullback-Leibler divergence, in nats, of the distributions that two arrays of logits stand for."""
    logs = lambda x: F.transform(x, lambda v: v - F.array_max(x) - F.ln(_sum(F.transform(x, lambda z: F.exp(z - F.array_max(x))))))
    return F.get(F.transform(F.array(F.struct(logs(real).alias("a"), logs(blank).alias("b"))), lambda s: _sum(F.zip_with(s["a"], s["b"], lambda x, y: F.exp(x) * (x - y)))), F.lit(0))
