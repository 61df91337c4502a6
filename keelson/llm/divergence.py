"""How the sources of a language differ: divergence of each pair of sources, and each source's most typical terms.

1. Terms are counted by language and source in tasks, block by block of text, and summed over the cluster; a term's documents are counted with
   its occurrences. A language keeps the terms of at least MIN_DOCS of its documents.
2. Each group's share of a term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two shares differ by f = floor((p - q)^2 / (p + q)), in
   integers (in decimals of 38 digits where longs could overflow).
3. Pairs: a term that neither source has adds the same f of their baselines (count 0). So V times that is corrected: by source, for
   the counts that it has (a histogram: few counts, many terms), against the other's baseline; and for the terms that both have, which a join
   on language and term finds. No pair meets a term that it lacks.
4. Ranking: each group's k largest values by radix select. A histogram over the highest ten bits of the values tells the digit in
   which the kth falls; rows above it are taken, those of the digit go on to the next ten bits. Rows that agree in value are
   told apart by the bytes of their UTF-8, two at a time, past what all of them have in common. What goes between tasks is histograms.

Defined cases: nulls in text, lang and source are empty strings; each row is a document, also if it repeats an id or all of another row; a
text without terms counts as one of its group; a language without kept terms has pairs of value 0 and no terms; a language with one source
has no pairs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, alone, table
from ._text import U, Words, buffers, mix, pieces, stream

MIN_DOCS, TOP, DIGIT, BITS = 10, 10, 10, 30
#: bytes of terms, [^\x00-\x40\x5B-\x60\x7B-\x7F]
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
_second = stream(71, 256)
_second[0x41:0x5B] = _second[0x61:0x7B]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of each piece of the texts; words are told apart by two hashes of 64 bits."""
    for batch in batches:
        for b in pieces(batch, "text"):
            buf, off = buffers(b.column("text"))
            w = Words(buf, off, LETTERS)
            if not len(w.hash):
                continue
            groups = pa.StructArray.from_arrays([b.column("lang"), b.column("source")], ["lang", "source"]).to_pylist()
            seen: dict[tuple, int] = {}
            code = np.array([seen.setdefault((g["lang"], g["source"]), len(seen)) for g in groups], np.int64)
            doc = w.doc()
            of = code[doc]
            key, other = mix(w.hash + mix(of.astype(U) + U(1))), w._hash(_second)
            order = np.lexsort((other, key))  # stable: documents stay in order within a term
            key, other, doc = key[order], other[order], doc[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (other[1:] != other[:-1])])
            fresh = new | np.concatenate([[True], doc[1:] != doc[:-1]])
            at = np.flatnonzero(new)
            first = order[at]
            size = w.end[first] - w.start[first]
            to = np.concatenate([[0], np.cumsum(size)])
            raw = w.buf[np.repeat(w.start[first] - to[:-1], size) + np.arange(to[-1])]
            raw = np.where((raw >= 0x41) & (raw <= 0x5A), raw + np.uint8(32), raw)
            term = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(raw.tobytes())]).cast(pa.string())
            names, own = list(seen), of[first]
            pick = lambda k: pa.DictionaryArray.from_arrays(pa.array(own), pa.array([x[k] for x in names], pa.string())).cast(pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pick(0), pick(1), term, pa.array(np.diff(np.append(at, len(key)))), pa.array(np.add.reduceat(fresh.astype(np.int64), at))], ["lang", "source", "term", "n", "docs"])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, and the language's total and whether this row stands for the term, of terms in at least min_docs documents of the language."""
    counts = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    return counts.withColumns({"total": F.sum("n").over(of), "_docs": F.sum("docs").over(of), "one": F.min("source").over(of) == F.col("source")}).where(F.col("_docs") >= min_docs).drop("docs", "_docs")


def share(count: str, of: str) -> Column:
    """p of a count (SQL, as are N + 2 V in of), exact."""
    short = f"1 + (1000000000 * (({count}) + 2)) div greatest({of}, 1)"
    long = f"1 + CAST((CAST(1000000000 AS DECIMAL(10, 0)) * CAST(({count}) + 2 AS DECIMAL(19, 0))) div CAST(greatest({of}, 1) AS DECIMAL(19, 0)) AS BIGINT)"
    return F.expr(f"CASE WHEN ({count}) < 9000000000 THEN {short} ELSE {long} END")


def gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, v, base, room (N + 2 V) of each group, and the language's (all_room)."""
    n = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("one").cast("long")).alias("ones"))
    found = docs.select("lang", "source").distinct().join(n, ["lang", "source"], "left").fillna(0, ["n", "ones"])
    lang = Window.partitionBy("lang")
    found = found.withColumns({"v": F.sum("ones").over(lang), "all_n": F.sum("n").over(lang)})
    found = found.select("lang", "source", "v", F.expr("n + 2 * v").alias("room"), F.expr("all_n + 2 * v").alias("all_room"))
    return found.withColumn("base", share("0L", "room"))


def pair_divergences(kept: DataFrame, known: DataFrame) -> DataFrame:
    """lang, source, item, value of each two sources of a language, both ways."""
    other = known.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    base = known.join(other, "lang").where("source < item").select("lang", "source", "item", F.expr(f"CASE WHEN v > 0 THEN v * {gap('base', 'other')} ELSE 0L END").alias("value"))
    own = kept.join(known, ["lang", "source"]).withColumn("p", share("n", "room"))
    counts = own.groupBy("lang", "source", "base", "p").agg(F.count(F.lit(1)).alias("m")).join(other, "lang").where("source <> item")
    alone_ = counts.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), F.expr(f"m * ({gap('p', 'other')} - {gap('base', 'other')})").alias("value"))
    a = own.select("lang", "term", "source", "p", "base")
    b = own.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("base").alias("other"))
    both = a.join(b, ["lang", "term"]).where("source < item").select("lang", "source", "item", F.expr(f"{gap('p', 'q')} - {gap('p', 'other')} - {gap('base', 'q')} + {gap('base', 'other')}").alias("value"))
    total = base.unionByName(alone_.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))).unionByName(both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    total = total.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return total.select("lang", "value", F.explode(ways).alias("w")).select("lang", "w.source", "w.item", "value")


def _common(a: str, b: str) -> str:
    """Bytes that two binaries have in common at their start."""
    n = f"least(length({a}), length({b}))"
    at = f"array_position(transform(sequence(1, greatest({n}, 1)), i -> coalesce(substring({a}, i, 1) = substring({b}, i, 1) AND i <= {n}, false)), false)"
    return f"CASE WHEN {at} = 0 THEN {n} ELSE CAST({at} - 1 AS INT) END"


def radix_top(rows: DataFrame, by: Sequence[str], k: int, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """by, item, value of the k rows of largest value in each group, ties to the smaller item by its UTF-8.

    rows: by (no nulls), item string (no two alike in a group), value long from 0 to 2^bits - 1. However many rows a group has, its histogram has at most
    2^DIGIT rows, or 65,793 by bytes, and at most k of these go back to the rows.
    """
    todo, taken = rows.select(*by, "item", "value").withColumn("want", F.lit(k)), []

    def step(todo: DataFrame, digit: Column, name: str) -> DataFrame:
        dealt = todo.withColumn("d", digit)
        before = F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hist = dealt.groupBy(*by, "want", "d").agg(F.count(F.lit(1)).alias("m")).withColumn("before", before).where("before < want")
        hist = hist.select(*by, "d", (F.col("before") + F.col("m") <= F.col("want")).alias("all"), (F.col("want") - F.col("before")).cast("int").alias("next"))
        out = scratch.save(dealt.join(hist, [*by, "d"]).select(*by, "item", "value", F.col("next").alias("want"), "all"), name)
        taken.append(out.where("all").select(*by, "item", "value"))
        return out.where("NOT all").drop("all")

    for shift in range(-(-bits // DIGIT) * DIGIT - DIGIT, -1, -DIGIT):
        todo = step(todo, -F.shiftright("value", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)), f"bits{shift}")
    todo = todo.withColumn("b", F.col("item").cast("binary"))
    while not todo.isEmpty():
        ends = todo.groupBy(*by).agg(F.min("b").alias("lo"), F.max("b").alias("hi")).select(*by, F.expr(_common("lo", "hi")).alias("skip"))
        todo = step(todo.join(ends, list(by)), F.expr("hex(substring(b, skip + 1, 2))"), "bytes").withColumn("b", F.col("item").cast("binary"))
    return reduce(DataFrame.unionByName, taken)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank of docs (text, lang, source)."""
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = scratch.save(kept_terms(docs, min_docs), "kept")
    known = scratch.save(groups(docs, kept), "groups")
    pairs = pair_divergences(kept, known)
    terms = kept.join(known, ["lang", "source"]).withColumns({"p": share("n", "room"), "q": share("total", "all_room")}).where("p > q")
    terms = radix_top(terms.select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value")), ("lang", "source"), top, scratch)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return out.select("lang", "source", "part", "item", "value", rank.alias("rank"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(alone(table(spark, sf_dir, "documents"), "text", "lang", "source"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT x.*, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY x.lang, source) + 2 * v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (total + 2) // (all_n + 2 * v) AS q
      FROM x JOIN v ON x.lang = v.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 10
"""
QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLE_SQL = {"op12_source_divergence": SQL}
