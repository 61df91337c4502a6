"""Language-model scores by a Brown class bigram model.

P(w | v) = P(class of w | class of v) P(w | class of w). Counts are of all training texts:

1. Words (their 64-bit hashes, and last two bytes) are counted; the HEAD most frequent go to all tasks, the others stay a table.
2. Bigrams of the CLUSTERED most frequent words are counted; exchange clustering on the driver moves each word in turn to the
   class where the average mutual information of adjacent classes grows most, until sweeps change nothing, 8 at most.
3. All other words of LEAST occurrences or more are put in as Brown's window does, by the classes beside them in all texts: their contexts
   are counted and compared on the cluster, a row a word comes back. Then all, the first too, are exchanged once more by the classes of
   all their neighbours. Rarer words tell too little of themselves (each by itself fits its own few places and no others): they, and unknown
   ones, have the class that fits all of those with their last two bytes best, and so have words beyond HEAD.
4. Class transitions are counted and smoothed towards class frequency; emissions are (c + 1) / (class tokens + class words + 1).
5. Texts are scored: frequent words by what tasks hold, the rest by a join with the word table, as log10(c + 1) is all
   that a rare word's count adds, and 0 for unknown ones.

What the driver gathers is bounded by CLUSTERED^2 bigrams and HEAD words with counts and classes; words and their counts have no bound.

Defined cases: a null or empty text is the end token alone; rows that repeat a doc_id are texts of their own; rows without
doc_id are training rows; without training texts all counts are 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._labels import held_out
from ._shared import Scratch, alone, table
from ._text import NOT_SPACE, U, Words, buffers, long_list, pieces

CLASSES, CLUSTERED, HEAD, LEAST = 32, 1500, 200_000, 5
OTHER, EDGE = CLASSES, CLASSES + 1  # when clustering: the class of words outside, and of text ends
SUFFIXES = 1 << 16


def _suffix(w: Words) -> np.ndarray:
    """The last two bytes of each word, A-Z as a-z."""
    low = lambda b: np.where((b >= 0x41) & (b <= 0x5A), b + 32, b).astype(np.int64)
    last = low(w.buf[w.end - 1])
    return last * 256 + np.where(w.end - w.start > 1, low(w.buf[np.maximum(w.end - 2, 0)]), 0)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for b in pieces(batch, "text", 1 << 21):
            yield b, Words(*buffers(b.column("text")), NOT_SPACE)


class _Sums:
    """Counts by key, merged now and then."""

    def __init__(self, most: int = 1 << 21):
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.size, self.most = 0, most

    def add(self, keys: np.ndarray, n: np.ndarray | None = None) -> bool:
        k, at, c = np.unique(keys, return_inverse=True, return_counts=True)
        self.keys.append(k)
        self.n.append(c if n is None else np.bincount(at, n, len(k)).astype(np.int64))
        self.size += len(k)
        if self.size > self.most:
            self.merge()
        return self.size > self.most // 2

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(self.n), len(k)).astype(np.int64)
        self.keys, self.n, self.size = [k], [n], len(k)
        return k, n

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merge()
        self.keys, self.n, self.size = [], [], 0
        return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, suffix = _Sums(), _Sums()

    def out() -> pa.RecordBatch:
        k, n = sums.take()
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n), pa.array(suffixes(k))], ["word", "n", "suffix"])

    seen: dict = {}

    def suffixes(k: np.ndarray) -> np.ndarray:
        words, s = np.concatenate(seen["w"]), np.concatenate(seen["s"])
        order = np.argsort(words)
        return s[order][np.searchsorted(words, k, sorter=order)].astype(np.int32)

    seen.update(w=[], s=[])
    for _, w in _words(batches):
        k, first = np.unique(w.hash, return_index=True)
        seen["w"].append(k)
        seen["s"].append(_suffix(w)[first].astype(np.int32))
        if sums.add(w.hash) or sum(map(len, seen["w"])) > 1 << 22:
            yield out()
            seen.update(w=[], s=[])
    if sums.keys:
        yield out()


def _sequence(w: Words, unit: np.ndarray, edge: int) -> np.ndarray:
    """Units of all texts in order, with an edge before the first and after each."""
    out = np.full(len(unit) + len(w.at), edge, np.int64)
    out[np.arange(len(unit)) + w.doc() + 1] = unit
    return out


def _ranks(h: np.ndarray, words: np.ndarray, rank: np.ndarray, default: int) -> np.ndarray:
    if not len(words):
        return np.full(len(h), default)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, rank[at], default)


def _pairs(words: np.ndarray, rank: np.ndarray, n: int):
    """Bigrams of ranks below n, n for other words and n + 1 for text ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for _, w in _words(batches):
            s = _sequence(w, np.minimum(_ranks(w.hash, words, rank, n), n), n + 1)
            sums.add(s[:-1] * (n + 2) + s[1:])
        k, c = sums.take()
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["key", "n"])

    return run


def _contexts(words: np.ndarray, rank: np.ndarray, of_word: np.ndarray, of_suffix: np.ndarray, first: int):
    """How often each unit (words of rank first and on, then suffixes of all others) has each class before and after it."""
    held, width = len(words), CLASSES + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()

        def out() -> pa.RecordBatch:
            k, c = sums.take()
            return pa.RecordBatch.from_arrays([pa.array(k // (2 * width)), pa.array(k), pa.array(c)], ["unit", "key", "n"])

        for _, w in _words(batches):
            r, tail = _ranks(w.hash, words, rank, held), _suffix(w)
            cls = _sequence(w, np.where(r < held, of_word[np.minimum(r, held - 1)] if held else OTHER, of_suffix[tail]), EDGE)
            unit = np.where(r < held, r, held + tail)
            at = np.arange(len(unit)) + w.doc() + 1
            some = r >= first
            if sums.add(np.concatenate([(unit * 2 * width + cls[at - 1])[some], (unit * 2 * width + width + cls[at + 1])[some]])):
                yield out()
        yield out()

    return run


def _placed(g: np.ndarray):
    """Rows in order of unit: the class of each."""
    width = CLASSES + 2

    def told(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        unit, at = np.unique(key // (2 * width), return_inverse=True)
        counts = np.bincount(at * 2 * width + key % (2 * width), n, len(unit) * 2 * width).reshape(-1, 2, width)
        return pa.RecordBatch.from_arrays([pa.array(unit), pa.array(_place(counts, g).astype(np.int64))], ["unit", "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for b in batches:
            held = [np.concatenate([x, b.column(k).to_numpy()]) for x, k in zip(held, ("key", "n"), strict=True)]
            unit = held[0] // (2 * width)
            cut = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
            if cut:
                yield told(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield told(*held)

    return run


def exchange(n: np.ndarray, classes: int = CLASSES, sweeps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word and the class bigram counts. n: bigrams of words, then of a symbol for others, then of text ends."""
    m = len(n) - 2
    cls = np.append(np.arange(m) % classes, [classes, classes + 1])
    g = np.zeros((classes + 2, classes + 2))
    np.add.at(g, (cls[:, None], cls[None, :]), n)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for w in range(m):
            own = cls[w]
            out, into = np.bincount(cls, n[w], classes + 2), np.bincount(cls, n[:, w], classes + 2)
            self_ = n[w, w]
            out[own] -= self_
            into[own] -= self_
            g[own] -= out
            g[:, own] -= into
            g[own, own] -= self_
            k = np.arange(classes)
            rows, cols, diag = g[:classes], g[:, :classes], g[k, k]
            gain = (f(rows + out) - f(rows)).sum(1) + (f(cols + into[:, None]) - f(cols)).sum(0)
            gain += f(diag + out[k] + into[k] + self_) - f(diag + out[k]) - f(diag + into[k]) + f(diag)
            r, c = g.sum(1)[:classes], g.sum(0)[:classes]
            gain -= f(r + out.sum() + self_) - f(r) + f(c + into.sum() + self_) - f(c)
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = int(own)
            moved += best != own
            cls[w] = best
            g[best] += out
            g[:, best] += into
            g[best, best] += self_
        if not moved:
            break
    return cls[:m], g


def _place(counts: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The class that fits counts (unit x before and after x class) best."""
    s = g + 0.1
    after = np.log(s[:CLASSES] / s[:CLASSES].sum(1, keepdims=True))
    before = np.log(s[:, :CLASSES] / s[:, :CLASSES].sum(0, keepdims=True)).T
    return (counts[:, 0] @ before.T + counts[:, 1] @ after.T).argmax(1)


class Model:
    """What tasks need: frequent words with counts and classes, classes of suffixes, transitions, sizes of classes."""

    def __init__(self, words, count, cls, of_suffix, transition, size, n, v):
        self.words, self.count, self.cls, self.of_suffix, self.transition, self.size, self.n, self.v = words, count, cls, of_suffix, transition, size, n, v


def _classes(w: Words, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Place among the frequent words, or -1, and class of each word."""
    at = _ranks(w.hash, m.words, np.arange(len(m.words)), -1)
    c = m.of_suffix[_suffix(w)]
    known = at >= 0
    c[known] = m.cls[at[known]]
    return at, c


def _transitions(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((CLASSES + 1) ** 2, np.int64)
        for _, w in _words(batches):
            s = _sequence(w, _classes(w, m)[1], CLASSES)
            n += np.bincount(s[:-1] * (CLASSES + 1) + s[1:], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["key", "n"])

    return run


def _scored(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.log10(np.append(m.count, 0) + 1.0)
        emit, base = -np.log10(m.size + 1.0), -np.log10(m.n + m.v + 1.0)
        for b, w in _words(batches):
            at, c = _classes(w, m)
            doc, rows = w.doc(), b.num_rows
            s = _sequence(w, c, CLASSES)
            step = m.transition[s[:-1], s[1:]]
            # texts share the edges between them: the step into an edge is of the text that ends there
            of = np.repeat(np.arange(rows), np.diff(w.at) + 1)
            value = count[at]  # the last, 0, for rare words
            n = np.diff(w.at)
            model = np.bincount(of, step, rows) + np.bincount(doc, value + emit[c], rows)
            plain = np.bincount(doc, value, rows) + n * base
            rare = np.flatnonzero(at < 0)
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"), pa.array(n), pa.array(np.bincount(doc[at >= 0], minlength=rows)), pa.array(plain), pa.array(model), long_list(w.hash[rare], np.searchsorted(rare, w.at))],
                ["rid", "doc_id", "n_words", "n_head", "base", "model", "rare"],
            )

    return run


def _grid(df: DataFrame, size: int) -> np.ndarray:
    got = df.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[got["key"].to_numpy()] = got["n"].to_numpy()
    return out


def _frequent(counts: DataFrame) -> DataFrame:
    """All words from a count on, at most HEAD of them: by a histogram of counts on a scale of eighths of powers of two, so nothing is sorted."""
    step = F.floor(F.log2("c") * 8)
    n, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        n += r["n"]
        if n > HEAD:
            break
        least = r["step"]
    return counts.where(F.lit(False) if least is None else step >= least)


def fit(train: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame]:
    """A model of texts, and the table of all words (word, c)."""
    texts = train.select("text")
    pairs = "key long, n long"
    counts = texts.mapInArrow(_word_counts, "word long, n long, suffix int").groupBy("word").agg(F.sum("n").alias("c"), F.first("suffix").alias("suffix"))
    counts = scratch.save(counts, "words")
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    texts_n = texts.count()
    top = _frequent(counts).toArrow()
    word, c = top["word"].to_numpy().view(U), top["c"].to_numpy()
    order = np.lexsort((word, -c))
    word, c, tail_of = word[order], c[order], top["suffix"].to_numpy()[order]
    clustered = min(CLUSTERED, len(word))
    held = max(clustered, int((c >= LEAST).sum()))

    def sorted_ranks(k: int) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(word[:k])
        return word[:k][by], by

    n = _grid(texts.mapInArrow(_pairs(*sorted_ranks(clustered), clustered), pairs), (clustered + 2) ** 2).reshape(clustered + 2, -1)
    n[clustered + 1, clustered + 1] = 0
    of_word, g = exchange(n)
    parts = max(1, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = sorted_ranks(held)

    def placed(of_word: np.ndarray, of_suffix: np.ndarray, g: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes of words of rank first and on, and of suffixes, by the classes of their neighbours."""
        seen = texts.mapInArrow(_contexts(*every, of_word, of_suffix, first), "unit long, key long, n long")
        got = seen.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_placed(g), "unit long, cls long").toArrow()
        out = np.append(of_word, np.zeros(SUFFIXES, np.int64))
        out[got["unit"].to_numpy()] = got["cls"].to_numpy()
        return out[:held], out[held:]

    start = np.append(of_word, np.full(held - clustered, OTHER))
    cls, of_suffix = placed(start, np.full(SUFFIXES, OTHER), g, clustered)
    # once more, by the classes of all neighbours and the transitions between all classes
    grid = (CLASSES + 1) ** 2
    t = _grid(texts.mapInArrow(_transitions(Model(every[0], None, cls[every[1]], of_suffix, None, None, 0, 0)), pairs), grid).reshape(CLASSES + 1, -1)
    whole = np.zeros((CLASSES + 2, CLASSES + 2))
    at = np.append(np.arange(CLASSES), EDGE)
    whole[np.ix_(at, at)] = t
    cls, of_suffix = placed(cls, of_suffix, whole, 0)
    cls = np.append(cls, of_suffix[tail_of[held:]])
    # tokens and words of classes: the frequent words one by one, the others by suffix
    size = np.bincount(cls, c + 1.0, CLASSES + 1).astype(np.float64)
    by = counts.groupBy("suffix").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toArrow()
    every, head = np.zeros(SUFFIXES), np.bincount(tail_of, c + 1.0, SUFFIXES)
    every[by["suffix"].to_numpy()] = by["c"].to_numpy() + by["v"].to_numpy()
    size += np.bincount(of_suffix, every - head, CLASSES + 1)
    n_tokens, n_types = (total[0] or 0) + texts_n, total[1] + (texts_n > 0)
    by = np.argsort(word)
    m = Model(word[by], c[by], cls[by], of_suffix, None, size, n_tokens, n_types)
    t = _grid(texts.mapInArrow(_transitions(m), pairs), grid).reshape(CLASSES + 1, -1)
    into = t.sum(0)
    share = (into + 1) / (into.sum() + CLASSES + 1)
    m.transition = np.log10((t + 2.0 * share) / (t.sum(1, keepdims=True) + 2.0))
    m.end_count = texts_n
    return m, counts


def class_scores(docs: DataFrame, train: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text); train: texts to learn from."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    m, counts = fit(train, scratch)
    sent = spark.sparkContext.broadcast(m)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(lambda bs: _scored(sent.value)(bs), "rid long, doc_id long, n_words long, n_head long, base double, model double, rare array<long>")
    rows = scratch.save(rows, "scored")
    rare = rows.select("rid", F.explode("rare").alias("word"))
    found = rare.join(counts.select("word", "c"), "word").groupBy(F.col("rid").alias("_rid")).agg(F.count(F.lit(1)).alias("n_rare"), F.sum(F.log10(F.col("c") + 1.0)).alias("gain"))
    out = rows.drop("rare").join(found, F.col("rid") == F.col("_rid"), "left")
    gain, n_rare = F.coalesce("gain", F.lit(0.0)), F.coalesce("n_rare", F.lit(0))
    end = float(np.log10((m.end_count + 1.0) / (m.n + m.v + 1.0)))
    return out.select(
        "doc_id",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_head") + n_rare + F.lit(int(m.end_count > 0))).cast("long").alias("n_known"),
        F.lit(int(m.n)).cast("long").alias("train_tokens"),
        (F.col("base") + gain + F.lit(end)).alias("base_score"),
        (F.col("model") + gain).alias("score"),
    )


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = alone(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = held_out(F.col("doc_id"), 7, 2)
    scores = class_scores(docs, docs.where(~out))
    return scores.select("doc_id", out.alias("held_out"), *scores.columns[1:])


QUERIES = {"op9_class_lm": op9_class_lm}
ORACLE_SQL: dict[str, str] = {}
