"""Questions with options, their rewritings, and what is asked of them, read as words and lines in Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words that a rewritten question may add or drop
STOP = (
    "a an the this that these those it its he his she her they their of in on at to for from with by and or as is are was were be been being do does did can could will would should have has had "
    "what which who whom whose how why what's who's according based given following presented provided shown video information evidence object action event person people"
).split()
#: fixed values: words that name no one, before "in the video"
ROLES = ("protagonist", "hero", "heroine", "man", "woman", "boy", "girl", "person")
#: fixed values: what counts as a word, as a tag, as a control character, and how a question of time opens
WORD = "[a-z]+(?:'[a-z]+)*|[0-9]+"
TAG = "<[^>]*>"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
OPENING = r"what\s+time\s+(?:do|does|did)\s+"
LETTERS = "ABCD"
BLANK = r"^\s+|\s+$"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def words(text: Column) -> Column:
    """Words, with inner apostrophes, and numbers, in lower case and in order."""
    plain = F.translate(F.lower(text), "‘’", "''")
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def _more(a: Column, b: Column) -> Column:
    """Words that a has more often than b, as often as it has them more."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.array_sort(F.flatten(F.transform(F.array_distinct(a), lambda w: F.array_repeat(w, F.greatest(count(a, w) - count(b, w), F.lit(0))))))


def rewriting(question: Column, raw: Column, truncated: Column) -> Column:
    """struct(query, reasons, added, missing) of a rewritten question: itself, or the question where there are reasons against it.

    Reasons: empty, multiline, truncated, marker (tags, bracketed option letters, control characters), answer (option letters or a heading), content (words beyond STOP that aren't the same, as often).
    """
    content = lambda t: F.filter(words(t), lambda w: ~w.isin(*STOP))

    def check(query: Column) -> Column:
        low = F.lower(query)
        marker = query.rlike(TAG) | query.rlike(CONTROL)
        for letter in LETTERS:
            marker = marker | query.contains(f"[{letter}]")
        pieces = F.split(low, r"\s+")
        letters = F.exists(pieces, lambda p: p.isin(*(x + end for x in LETTERS.lower() for end in ".)")))
        heading = F.exists(F.array(*map(F.lit, ("answer", "description", "query", "explanation"))), lambda h: F.startswith(low, h) & F.startswith(F.ltrim(F.replace(F.substr(low, F.char_length(h) + 1), F.lit("\t"), F.lit(" "))), F.lit(":")))

        def judge(c: Column) -> Column:
            added, missing = _more(c["after"], c["before"]), _more(c["before"], c["after"])
            faults = {"empty": query == "", "multiline": query.contains("\n") | query.contains("\r"), "truncated": truncated, "marker": marker, "answer": letters | heading, "content": (F.size(added) > 0) | (F.size(missing) > 0)}
            reasons = F.filter(F.array(*(F.when(v, k) for k, v in faults.items())), lambda r: r.isNotNull())
            return F.struct(F.when(F.size(reasons) > 0, question).otherwise(query).alias("query"), reasons.alias("reasons"), added.alias("added"), missing.alias("missing"))

        return _bound(F.struct(content(question).alias("before"), content(query).alias("after")), judge)

    return _bound(stripped(raw), check)


def _label(line: Column) -> Column:
    """struct(letter, length) of the option letter that a line begins with, (A), A. or A), with space after it; else null."""

    def read(bare: Column) -> Column:
        at = lambda i: F.substring(bare, i, 1)
        letter = F.when((at(1) == "(") & (at(3) == ")"), at(2)).when(at(2).isin(".", ")"), at(1))
        size = F.when(at(1) == "(", 3).otherwise(2)
        space = F.regexp_replace(F.substr(bare, size + 1, F.lit(1)), r"\s", "") == ""
        return F.when(letter.isin(*LETTERS) & space, F.struct(letter.alias("letter"), (F.char_length(line) - F.char_length(bare) + size).alias("length")))

    return _bound(F.regexp_replace(line, r"^\s+", ""), read)


def problem(text: Column) -> Column:
    """struct(question, options, letters) of a question and four labelled options, each of one line or more, in the order that they are shown in; null for any other text.

    Line ends may be written out as backslash and letter. Letters are A to D, each once; question and options aren't empty, and no two options alike.
    """
    plain = F.replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))

    def read(lines: Column) -> Column:
        marks = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("at"), _label(line).alias("label"))), lambda m: m["label"].isNotNull())

        def parts(m: Column) -> Column:
            between = lambda a, b: F.array_join(F.slice(lines, a + 1, b - a), "\n")
            option = lambda x, k: stripped(F.substr(between(x["at"], F.coalesce(F.get(m, k + 1)["at"], F.size(lines))), x["label"]["length"] + 1))
            letters = F.transform(m, lambda x: x["label"]["letter"])
            found = F.struct(stripped(between(F.lit(0), F.get(m, F.lit(0))["at"])).alias("question"), F.transform(m, option).alias("options"), letters.alias("letters"))
            return F.when((F.size(m) == len(LETTERS)) & (F.size(F.array_distinct(letters)) == len(LETTERS)), found)

        return _bound(marks, parts)

    good = lambda p: F.when((p["question"] != "") & ~F.array_contains(p["options"], "") & (F.size(F.array_distinct(p["options"])) == len(LETTERS)), p)
    return _bound(_bound(F.split(stripped(plain), "\n"), read), good)


def _clock(text: Column) -> Column:
    """Whether a text is hours, minutes and seconds, with or without a fraction."""
    p = F.split(text, ":")
    tail = F.split(F.get(p, F.lit(2)), r"\.")
    digits = lambda x, least, most: F.coalesce(x.rlike("^[0-9]+$") & F.char_length(x).between(least, most), F.lit(False))
    part = (F.size(tail) == 1) | ((F.size(tail) == 2) & digits(F.get(tail, F.lit(1)), 1, 99))
    return (F.size(p) == 3) & digits(F.get(p, F.lit(0)), 1, 2) & digits(F.get(p, F.lit(1)), 2, 2) & digits(F.get(tail, F.lit(0)), 2, 2) & F.coalesce(part, F.lit(False))


def time_heading(text: Column) -> Column:
    """Whether a text is a heading of a stretch of time and nothing else: one to six #, then From [H:MM:SS to H:MM:SS]:, whatever the case."""
    body = F.lower(stripped(text))
    rest = F.regexp_replace(body, "^#+", "")
    count = F.char_length(body) - F.char_length(rest)
    inner = stripped(F.regexp_replace(stripped(rest), "^from", ""))
    closed = F.regexp_replace(inner, r"\s*:$", "")
    times = F.split(stripped(F.substr(closed, F.lit(2), F.char_length(closed) - 2)), r"\s+to\s+")
    shaped = count.between(1, 6) & F.startswith(stripped(rest), F.lit("from")) & F.startswith(inner, F.lit("[")) & (closed != inner) & F.endswith(closed, F.lit("]"))
    return F.coalesce(shaped & (F.size(times) == 2) & _clock(F.get(times, F.lit(0))) & _clock(F.get(times, F.lit(1))), F.lit(False))


def option_defects(options: Column, letters: Column) -> Column:
    """Structs (letter, option, reason) of options that are empty or only a heading of a stretch of time."""
    reason = lambda o: F.when(stripped(o) == "", "empty_option").when(time_heading(o), "time_heading_only")
    return F.filter(F.zip_with(letters, options, lambda k, o: F.struct(k.alias("letter"), o.alias("option"), reason(o).alias("reason"))), lambda d: d["reason"].isNotNull())


def option_structure(question: Column, options: Column) -> Column:
    """counts (the question asks how many, and all options are whole numbers), permutations (all options are orders of the events (a), (b), ... that lines of the question begin with), or other."""
    body = lambda o: stripped(F.when(F.substring(stripped(o), 1, 1).isin(*LETTERS) & F.substring(stripped(o), 2, 1).isin(".", ")"), F.substr(stripped(o), F.lit(3))).otherwise(o))
    asked = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9_]+|[^a-z0-9_ ]"), F.lit(0)), " "), F.lit(" "))
    counts = asked.contains(" how many ") & F.forall(options, lambda o: body(o).rlike(r"^[0-9]+\.?$"))
    lines = F.transform(F.split(F.lower(question), "\n"), stripped)
    named = F.filter(lines, lambda x: F.startswith(x, F.lit("(")) & (F.substring(x, 3, 1) == ")") & F.substring(x, 2, 1).between("a", "z") & F.substring(x, 4, 1).isin(" ", "\t") & (stripped(F.substr(x, F.lit(4))) != ""))
    events = F.array_sort(F.transform(named, lambda x: F.substring(x, 2, 1)))
    refs = lambda o: F.split(F.regexp_replace(F.regexp_replace(F.lower(body(o)), r"\s", ""), r"\.$", ""), "")

    def permutes(o: Column) -> Column:
        """A row of bracketed letters, three signs each."""
        marks = refs(o)
        n = F.size(marks)
        shaped = (n % 3 == 0) & F.forall(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 3 == 0, F.get(marks, i) == "(").when(i % 3 == 2, F.get(marks, i) == ")").otherwise(F.get(marks, i).between("a", "z")))
        return shaped & (F.array_sort(F.filter(marks, lambda m: m.between("a", "z"))) == events)

    orders = (F.size(events) >= 2) & (F.size(F.array_distinct(events)) == F.size(events)) & F.forall(options, permutes)
    return F.when(counts, "counts").when(orders, "permutations").otherwise("other")


def event_clause(question: Column) -> Column:
    """struct(clause, start, end, subject, reason): the event of a question "(at) what time do|does|did ...", an exact stretch of the question (end exclusive), without a role that names no one before it.

    The whole question, with a reason, where it is asked in another way (unsupported), or where something but "In the video," or "According to the video," leads it (leading_condition), which would be lost. A blank
    question is an error.
    """

    def read(q: Column, low: Column, m: Column) -> Column:
        begin, after = m["begin"], m["begin"] + F.char_length(m["opening"]) - 1  # characters up to the clause
        lead = stripped(F.regexp_replace(stripped(F.substr(low, F.lit(1), begin - 1)), r"(^|\s)at$", ""))
        neutral = stripped(F.regexp_replace(lead, ",$", "")).isin("", "in the video", "according to the video")

        def subject(rest: Column, w: Column) -> Column:
            kind = F.get(w, F.lit(1)).isin("male", "female")
            at = lambda i: F.get(w, F.when(kind, i + 1).otherwise(i))
            role = F.get(w, F.lit(0)).isin("the", "a") & at(F.lit(1)).isin(*ROLES) & (at(F.lit(2)) == "in") & (at(F.lit(3)) == "the") & (at(F.lit(4)) == "video")
            return F.when(F.coalesce(role, F.lit(False)), F.when(kind, F.regexp_extract(rest, r"^(?:\S+\s+){6}", 0)).otherwise(F.regexp_extract(rest, r"^(?:\S+\s+){5}", 0))).otherwise("")

        def cut(x: Column) -> Column:
            start = after + F.char_length(x["subject"])
            none = F.lit(None).cast("string")
            return _bound(F.substr(q, start + 1, F.greatest(x["ended"] - start, F.lit(0))), lambda clause: F.struct(clause.alias("clause"), start.alias("start"), (start + F.char_length(clause)).alias("end"), x["subject"].alias("subject"), none.alias("reason")))

        named = _bound(F.substr(q, after + 1), lambda rest: _bound(F.split(F.lower(rest), r"\s+"), lambda w: subject(rest, w)))
        found = _bound(F.struct(named.alias("subject"), F.char_length(F.regexp_replace(q, r"\s*\??\s*$", "")).alias("ended")), cut)
        whole = lambda reason: F.struct(q.alias("clause"), F.lit(0).alias("start"), F.char_length(q).alias("end"), F.lit("").alias("subject"), F.lit(reason).alias("reason"))
        return F.when(begin == 0, whole("unsupported")).when(~neutral, whole("leading_condition")).otherwise(found)

    def check(q: Column) -> Column:
        hit = lambda low: F.struct(F.regexp_instr(low, F.lit(OPENING)).alias("begin"), F.regexp_extract(low, OPENING, 0).alias("opening"))
        blank = F.coalesce(stripped(q) == "", F.lit(True))
        told = _bound(F.lower(q), lambda low: _bound(hit(low), lambda m: read(q, low, m)))
        return F.when(blank, F.raise_error(F.lit("a question is needed")).cast("struct<clause:string,start:int,end:int,subject:string,reason:string>")).otherwise(told)

    return _bound(question, check)


_NONE = "array<string>"


def _texts(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, _NONE), F.array().cast(_NONE))


def facts(raw: Column, truncated: Column, fields: tuple[str, ...] = ("observations", "visible_text"), most: int = 3) -> Column:
    """struct(valid, strict, fenced, each field, reason) of a JSON object of these fields only, each a list of at most so many texts that aren't blank. A whole fence of code round it is allowed, but isn't strict.

    Reasons: truncated, not_json, shape (other fields, or values of another kind), list (too many, or a blank one). What isn't valid has empty lists.
    """
    kinds = [f"OBJECT<{', '.join(f'{f}: ARRAY<{k}>' for f, k in zip(sorted(fields), ks, strict=True))}>" for ks in product(("STRING", "VOID"), repeat=len(fields))]

    def read(v: Column, fenced: Column) -> Column:
        def judge(x: Column) -> Column:
            good = F.lit(True)
            for f in fields:
                good &= (F.size(x[f]) <= most) & F.forall(x[f], lambda t: F.coalesce(stripped(t) != "", F.lit(False)))
            reason = F.when(truncated, "truncated").when(v.isNull(), "not_json").when(~F.schema_of_variant(v).isin(*kinds), "shape").when(~good, "list")
            none = F.array().cast(_NONE)
            return _bound(reason, lambda r: F.struct(r.isNull().alias("valid"), (r.isNull() & ~fenced).alias("strict"), fenced.alias("fenced"), *(F.when(r.isNull(), x[f]).otherwise(none).alias(f) for f in fields), r.alias("reason")))

        return _bound(F.struct(*(_texts(v, f"$.{f}").alias(f) for f in fields)), judge)

    def unfenced(text: Column) -> Column:
        inner = F.regexp_extract(text, r"(?s)^```(?:json)?[ \t]*\n(.*)\n```$", 1)
        return _bound(inner, lambda x: _bound(F.try_parse_json(F.when(x != "", x).otherwise(text)), lambda v: read(v, x != "")))

    return _bound(stripped(raw), unfenced)


#: fixed values: small words that any phrase may hold, and what stands for an action's thing
SMALL = "a an the of with in on to from his her their its this that and or person people man woman girl boy".split()
THINGS = {"biking": "bicycle", "cycling": "bicycle", "skateboarding": "skateboard", "driving": "vehicle", "walking": "person"}


def object_queries(raw: Column, question: Column, options: Column, known: int = 6, each: int = 3) -> Column:
    """struct(known, choices, reason) of a JSON object of known (phrases for the question) and choices (a list of phrases for each of four options), all in words that the question, or the option, licenses; empty with a reason otherwise.

    Licensed are a text's words, their singulars by a final s, the things of its actions, and small words. Phrases are lower-cased, each once. Reasons: not_json, shape, bound (too many), phrase (blank, long or of two lines), word.
    """
    letters = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0))

    def licensed(source: Column) -> Column:
        own = F.regexp_extract_all(F.lower(source), F.lit("[a-z]+(?:'[a-z]+)?"), F.lit(0))
        singular = F.transform(F.filter(own, lambda w: F.endswith(w, F.lit("s")) & (F.char_length(w) > 3)), lambda w: F.substr(w, F.lit(1), F.char_length(w) - 1))
        things = F.filter(F.array(*(F.when(F.array_contains(own, k), v) for k, v in THINGS.items())), lambda t: t.isNotNull())
        return F.flatten(F.array(own, singular, things, F.array(*map(F.lit, SMALL))))

    kinds = [f"OBJECT<choices: ARRAY<{c}>, known: ARRAY<{k}>>" for c in ("ARRAY<STRING>", "ARRAY<VOID>") for k in ("STRING", "VOID")]

    def read(v: Column) -> Column:
        none = F.array().cast(_NONE)

        def judge(x: Column) -> Column:
            groups, said = x["groups"], x["said"]
            fine = F.forall(F.flatten(groups), lambda p: F.coalesce((stripped(p) != "") & (F.char_length(p) <= 80) & ~p.contains("\n"), F.lit(False)))
            allowed = lambda g, s: _bound(licensed(s), lambda words_: F.forall(g, lambda p: (F.size(p) > 0) & (F.size(F.array_except(p, words_)) == 0)))
            own = F.zip_with(said, F.concat(F.array(question), options), lambda g, s: F.when(F.size(g) == 0, True).otherwise(allowed(g, s)))
            shaped = F.schema_of_variant(v).isin(*kinds) & (F.size(groups) == 5)
            bounded = (F.size(F.get(groups, F.lit(0))) <= known) & F.forall(F.slice(groups, 2, 4), lambda g: F.size(g) <= each)
            reason = F.when(v.isNull(), "not_json").when(~shaped, "shape").when(~bounded, "bound").when(~fine, "phrase").when(~F.forall(own, lambda y: y), "word")
            plain = F.transform(said, lambda g: F.array_distinct(F.transform(g, lambda p: F.array_join(p, " "))))
            return _bound(reason, lambda r: _bound(F.when(r.isNull(), plain), lambda ok: F.struct(F.when(r.isNull(), F.get(ok, F.lit(0))).otherwise(none).alias("known"), F.when(r.isNull(), F.slice(ok, 2, 4)).otherwise(F.array_repeat(none, 4)).alias("choices"), r.alias("reason"))))

        groups = F.concat(F.array(_texts(v, "$.known")), F.coalesce(F.try_variant_get(v, "$.choices", "array<array<string>>"), F.array().cast("array<array<string>>")))
        return _bound(_bound(groups, lambda g: F.struct(g.alias("groups"), F.transform(g, lambda ps: F.transform(ps, letters)).alias("said"))), judge)

    return _bound(F.try_parse_json(stripped(raw)), read)
