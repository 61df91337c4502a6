"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

1. Each text's distinct shingles are sorted by hash. Of BINS equal ranges of hashes, the least in each is the signature; an
   empty bin borrows from the bin that its own probe sequence finds first, the same sequence for all texts.
2. Texts with equal shingle sets are one class, named by its smallest doc_id, so groups of copies cost one row.
3. Classes meet in buckets, one for each band of ROWS signature entries. Each bucket gives edges from its smallest class
   to the others only, so there are no more edges than rows. Edges are verified on full sets.
4. Components of verified edges. Texts of buckets that still hold several components form stars again, round other centres
   and in ever finer buckets (of FINER bands together), between different components only: what one star's centre could not link,
   another can, and there are still no more edges than rows, however many texts are nearly similar enough.
5. Stars alone leave pairs out where a bucket is crowded. So in the buckets that still hold several components, all pairs
   of different components are compared, in tiles of TILE texts, by exact bounds: the sizes, and the bits in which two parity bitmaps
   of MARKS bits differ, which are never more than the elements that the sets don't share. Only pairs that both bounds let through
   leave a task, and are verified on full sets. The comparisons are quadratic in what stays open in a bucket, the rows are not.
6. Components again, over all verified edges.

At a similarity of 0.8, a pair shares no bucket with a probability of (1 - 0.8^4)^32 = 5e-8; all pairs that share one are linked
or in one component.

Defined cases: a null text, or one without words, has no shingles and links with nothing; a text of fewer words than a
shingle is one shingle; rows that repeat a doc_id are one node, linked by any of its texts; rows without doc_id get their n_shingles, no component
and are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import connected_components
from ._shared import Scratch, alone, table
from ._text import NOT_SPACE, U, Words, buffers, long_list, mix, pieces, shingles, stream

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: how many bands together make a bucket in the rounds of step 4, and buckets of a text in these rounds
FINER, BUCKETS = (1, 2), 96
TILE, MARKS, SALTS = 2048, 4096, 16
_PROBES = 512
_probe = (np.vstack([mix(stream(101 + k, BINS)) for k in range(_PROBES)]) >> U(57)).astype(np.int64)
_salt = stream(7, BANDS)


def _picks(seed: int, depth: int) -> np.ndarray:
    """BUCKETS fixed choices of depth bands."""
    rank = np.argsort(stream(5000 + seed, BUCKETS * BANDS).reshape(BUCKETS, BANDS), 1)
    return np.sort(rank[:, :depth], 1)


def densify(sig: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Optimal densification of signature rows, each with one filled bin at least."""
    out = sig.copy()
    row, col = np.nonzero(~filled)
    for k in range(_PROBES):
        if not len(row):
            return out
        src = _probe[k, col]
        ok = filled[row, src]
        out[row[ok], col[ok]] = sig[row[ok], src[ok]]
        row, col = row[~ok], col[~ok]
    for r, c in zip(row, col, strict=True):  # so rare that the nearest filled bin will do
        for step in range(1, BINS):
            if filled[r, (c + step) % BINS]:
                out[r, c] = sig[r, (c + step) % BINS]
                break
    return out


def sets_of(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text, its distinct shingle hashes in order."""
    buf, off = buffers(texts)
    h, at = shingles(Words(buf, off, NOT_SPACE), n)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        s = np.sort(h[a:b])
        if b - a > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    sig, filled = np.zeros((len(sets), BINS), U), np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        bins = (s >> U(57)).astype(np.int64)
        head = np.concatenate([[True], bins[1:] != bins[:-1]]) if len(s) else np.zeros(0, bool)
        sig[i, bins[head]], filled[i, bins[head]] = s[head], True
    some = filled.any(1)
    sig[some] = densify(sig[some], filled[some])
    return sig


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                sets = sets_of(b.column("text"), n)
                sig = signatures(sets)
                acc = np.zeros((len(sets), BANDS), U)
                for r in range(ROWS):
                    acc = mix(acc * U(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
                bands = mix(acc ^ _salt)
                size = np.array([len(s) for s in sets], np.int64)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                at = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(size), pa.array(digests, pa.binary()), long_list(bands[size > 0].ravel(), at)],
                    ["doc_id", "n_shingles", "set_id", "bands"],
                )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                sets = sets_of(b.column("text"), n)
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), long_list(np.concatenate(sets) if sets else np.zeros(0, U), at)], ["rep", "items"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose full sets are similar enough."""
    of_b = pairs.hint("merge").join(sets.select(F.col("rep").alias("b"), F.col("items").alias("items_b")), "b")
    both = of_b.hint("merge").join(sets.select(F.col("rep").alias("a"), F.col("items").alias("items_a")), "a")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.where(100 * common >= percent * (F.size("items_a") + F.size("items_b") - common)).select("a", "b").distinct()


def _full_sets(docs: DataFrame, pairs: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """Sets of all classes in pairs: the one time that texts are shuffled, by merge at any size."""
    used = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    texts = docs.join(used.hint("merge"), docs["doc_id"] == used["rep"]).select("doc_id", "text").dropDuplicates(["doc_id", "text"])
    return scratch.save(texts.mapInArrow(_sets(n), "rep long, items array<long>"), "sets")


def _open(rows: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with their components, and the bands whose buckets hold several, with the smallest."""
    named = rows.join(comps, rows["rep"] == comps["node"], "left").select("band", "rep", "n_shingles", F.coalesce("component", "rep").alias("comp"))
    return named, named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "lo")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set its size and, by the last bits of hashes, whether an odd number of elements has them."""
    for b in batches:
        col = b.column("items")
        size = np.diff(col.offsets.to_numpy())
        at = col.flatten().to_numpy().view(U) & U(MARKS - 1)
        bits = np.zeros((len(size), MARKS), np.uint8)
        np.bitwise_xor.at(bits, (np.repeat(np.arange(len(size)), size), at.astype(np.int64)), 1)
        yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(size.astype(np.int64)), pa.array([x.tobytes() for x in np.packbits(bits, 1)], pa.binary())], ["rep", "n", "bits"])


def _crossing(percent: int):
    """Rows in order of band, x, y and side: pairs of different components in tile x, or of tiles x and y, that can be similar enough."""

    def pairs(comp, rep, n, bits, side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        mid = int(np.searchsorted(side, 1))
        for i in range(mid):
            j = np.arange(i + 1, len(rep)) if mid == len(rep) else np.arange(mid, len(rep))
            j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            if len(j):
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
                j = j[(100 + percent) * apart <= (100 - percent) * (n[j] + n[i])]
                yield np.minimum(rep[j], rep[i]), np.maximum(rep[j], rep[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["band", "x", "y", "comp", "rep", "n", "side"], None
        for b in batches:
            cols = [b.column(k).to_numpy() for k in names] + [buffers(b.column("bits"))[0].reshape(-1, MARKS // 8)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])
            edge = np.flatnonzero(new) + 1
            if len(edge):
                yield from told(held, np.append(0, edge))
                held = [x[edge[-1] :] for x in held]
        if held is not None and len(held[0]):
            yield from told(held, np.array([0, len(held[0])]))

    def told(held: list[np.ndarray], edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, _, _, comp, rep, n, side, bits = held
        bits = np.ascontiguousarray(bits).view(U)
        found = [p for a, z in zip(edge[:-1], edge[1:], strict=True) for p in pairs(comp[a:z], rep[a:z], n[a:z], bits[a:z], side[a:z])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in found])) for k in (0, 1)], ["a", "b"])

    return run


def _crossed(rows: DataFrame, comps: DataFrame, full: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Distinct pairs (a, b) of different components that share a bucket and can be similar enough."""
    named, open_ = _open(rows, comps)
    held = scratch.save(named.join(open_.select("band"), "band").select("band", "rep", "comp").distinct(), "open")
    tiles = held.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("rep", "band"), F.col("tiles").cast("long")).cast("int")
    dealt = held.join(tiles, "band").select("band", "rep", "comp", tile.alias("t"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
    dealt = dealt.select("band", F.least("t", "u").alias("x"), F.greatest("t", "u").alias("y"), (F.col("t") > F.col("u")).cast("int").alias("side"), "rep", "comp")
    used = held.select("rep").distinct()
    marks = full.join(used, "rep", "left_semi").mapInArrow(_marked, "rep long, n long, bits binary")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = dealt.join(marks, "rep").repartition(parts, "band", "x", "y").sortWithinPartitions("band", "x", "y", "side")
    return scratch.save(met.mapInArrow(_crossing(percent), "a long, b long").distinct(), "crossed")


def _merged(comps: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """Components over edges (a, b) more, from those without: their stars stand for the edges that made them."""
    return connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), scratch)


def _same_ids(signed: DataFrame, member: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between an id and the classes of its texts, for ids that repeat with different sets, be one empty."""
    several = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi").select("doc_id")
    rows = member.join(several, "doc_id").select("doc_id", "set_id").distinct().join(classes.select("set_id", "rep"), "set_id")
    return scratch.save(rows.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "again")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession)
    signed = scratch.save(docs.select("doc_id", "text").mapInArrow(_signed(n), "doc_id long, n_shingles long, set_id binary, bands array<long>"), "signed")
    member = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(member.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    again = _same_ids(signed, member, classes, scratch)
    head = classes.select(F.col("set_id").alias("_set"), "rep")
    reps = member.join(head, (member["set_id"] == head["_set"]) & (member["doc_id"] == head["rep"])).select("rep", "n_shingles", "bands").dropDuplicates(["rep", "n_shingles", "bands"])
    reps = scratch.save(reps, "reps")
    every = reps.select("rep", "n_shingles", F.explode("bands").alias("band"))
    heads = scratch.save(every.groupBy("band").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").select("band", "head"), "heads")
    rows = scratch.save(every.join(heads.select("band"), "band").select("rep", "n_shingles", "band"), "rows")
    stars = scratch.save(rows.join(heads, "band").where("rep > head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    # members of buckets that several classes share are all in stars, so later rounds need no other sets
    full = _full_sets(docs, stars, n, scratch)
    linked = scratch.save(_verified(stars, full, percent), "linked")
    scratch.drop(stars)
    comps = scratch.save(connected_components(linked.unionByName(again), scratch), "components")
    # stars again, round other centres and in ever finer buckets, where components still meet
    for k, depth in enumerate(FINER):
        named, open_ = _open(rows, comps)
        held = named.join(open_, "band").select("rep", "comp").distinct()
        finer = rows.join(open_, "band").join(comps, rows["rep"] == comps["node"], "left").select("rep", F.coalesce("component", "rep").alias("comp"), "band")
        if depth > 1:
            sets = held.join(reps.select(F.col("rep").alias("_rep"), "bands"), F.col("rep") == F.col("_rep"))
            picks = F.lit([[int(x) for x in v] for v in _picks(k, depth)])
            finer = sets.select("rep", "comp", F.explode(F.transform(picks, lambda v: F.xxhash64(v, F.transform(v, lambda i: F.get("bands", i))))).alias("band"))
        finer = scratch.save(finer, "finer")
        order = F.xxhash64("rep", "band", F.lit(k))
        heads = finer.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("rep", "comp"), order).alias("head")).where("lo < hi").select("band", "head")
        stars = finer.join(heads, "band").where("comp <> head.comp").select(F.least("rep", "head.rep").alias("a"), F.greatest("rep", "head.rep").alias("b")).distinct()
        stars = scratch.save(stars.join(linked, ["a", "b"], "left_anti"), "stars")
        scratch.drop(finer)
        if stars.isEmpty():
            continue
        more = scratch.save(_verified(stars, full, percent), "linked")
        scratch.drop(stars)
        if not more.isEmpty():
            linked = linked.unionByName(more)
            comps = scratch.save(_merged(comps, more, scratch), "components")
    # what no centre linked: all pairs across the components of a bucket
    crossed = _crossed(rows, comps, full, percent, scratch)
    if not crossed.isEmpty():
        more = scratch.save(_verified(crossed, full, percent), "linked")
        if not more.isEmpty():
            comps = scratch.save(_merged(comps, more, scratch), "components")
    # back to documents: those of a class with copies by their class, in SALTS groups each, as one class may hold a third of them; others by themselves
    shared = classes.where("copies > 1").join(comps, F.col("rep") == F.col("node"), "left").select(F.col("set_id").alias("_set"), F.coalesce("component", "rep").alias("of_class"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    home = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    named = home.join(shared, (F.col("set_id") == F.col("_set")) & (F.col("salt") == F.col("_salt")), "left").select("doc_id", "n_shingles", "of_class")
    out = named.join(comps, F.col("doc_id") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(alone(table(spark, sf_dir, "documents"), "doc_id", "text"), n=2, percent=80)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m ON node = doc_id
"""
QUERIES = {"op2_minhash": op2_minhash}
ORACLE_SQL = {"op2_minhash": SQL}
