"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed lexicon and of a learned one (words and word beginnings that toxic training texts
favour), nearness of second-person words to lexicon words, rates of capitals, of punctuation and of obfuscated words.
Words are compared in a plain form: lower case, digits and signs that stand for letters read as those, other ASCII signs left out.

The lexicon and the trees learn from at most TRAIN_ROWS labelled rows, saved once with their texts; a fifth of these calibrates scores.
The lexicon has at most LEXICON words and beginnings, of the CANDIDATES that most toxic training texts hold, each in three of them or more (and in one of a thousand). Texts aren't
shuffled: the training rows are broadcast (doc_id and label), features are 18 numbers a text.

Defined cases: a null text counts as empty; an empty text has features of 0 and a score like any other; rows that repeat
a doc_id are scored each; without labels of both kinds every score is the share of label 1 (0 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._labels import held_out, labelled_texts, training_rows
from ._shared import Scratch, alone, table
from ._text import NOT_SPACE, U, Words, buffers, mix, pieces, stream

TRAIN_ROWS, CANDIDATES, LEXICON = 40_000, 50_000, 5_000
PREFIXES = (4, 5, 6)
SPAN = 3
BASE = """idiot idiots stupid moron morons trash scum loser losers pathetic worthless disgusting clown dumb fool garbage filth vermin creep jerk
idiote stupide imbécile crétin connard débile ordure racaille minable nul
dumm blöd trottel abschaum versager arschloch müll ekelhaft wertlos
idiota estúpido estúpida imbécil tonto basura escoria payaso patético perdedor asqueroso inútil""".split()
SECOND = "you your yours yourself u ur tu toi te ton vous votre du dich dir dein ihr euch tú ti usted ustedes vos".split()
FEATURES = ("n_words", "base", "base_n", "learned", "learned_n", "learned_max", "learned_sum", "begin_n", "begin_max", "second", "second_near", "capitals", "shouted", "exclaimed", "asked", "signs", "digits", "obfuscated")

_plain = np.arange(256, dtype=np.uint8)
_plain[0x41:0x5B] = np.arange(0x61, 0x7B)
for _from, _to in zip(b"013457@$!", b"oieastasi", strict=True):
    _plain[_from] = _to
_sign = np.zeros(256, bool)
_sign[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_letter = np.zeros(256, bool)
_letter[0x41:0x5B] = _letter[0x61:0x7B] = True
_letter[0x80:] = True
_skipped = _sign.copy()
_skipped[list(b"@$")] = False
_T, _Q = stream(11, 256), stream(31, 8)


def plain_words(buf: np.ndarray, off: np.ndarray) -> Words:
    """Words of the texts in plain form; those of signs only vanish."""
    keep = ~_skipped[buf]
    at = np.concatenate([[0], np.cumsum(keep)])
    return Words(_plain[buf[keep]], at[off], NOT_SPACE, fold=False)


def beginnings(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of k bytes or more, and the hash of their first k."""
    of = np.flatnonzero(w.end - w.start >= k)
    h = np.full(len(of), k, U)
    for j in range(k):
        h = h * U(0xD6E8FEB86659FD93) + _T[w.buf[w.start[of] + j]]
    return of, mix(h)


def hashes_of(words: list[str]) -> np.ndarray:
    return np.sort(plain_words(*buffers(pa.array(words))).hash)


def _within(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each x in the sorted table, or -1."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def _keys(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and word of each word and word beginning."""
    doc, hs, at = w.doc(), [w.hash], [np.arange(len(w.hash))]
    for k in PREFIXES:
        of, h = beginnings(w, k)
        hs.append(h)
        at.append(of)
    at = np.concatenate(at)
    return np.concatenate(hs), doc[at], at


def _document_counts(wanted: np.ndarray | None):
    """In how many documents (y: of the label) each key occurs, of the wanted keys only if there are such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                h, doc, _ = _keys(plain_words(*buffers(b.column("text"))))
                if wanted is not None:
                    ok = _within(h, wanted) >= 0
                    h, doc = h[ok], doc[ok]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                head = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                keys, n = np.unique(h[head], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def learn_lexicon(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys that toxic texts favour, and their log odds. texts: text, y."""
    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    count = lambda y, wanted: texts.where(F.col("y") == y).select("text").mapInArrow(_document_counts(wanted), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    few = max(3, n.get(1, 0) // 1000)
    seen = count(1, None).where(F.col("n") >= few).orderBy(F.desc("n"), "key").limit(CANDIDATES).collect()
    keys = np.array([r["key"] for r in seen], np.int64).view(U)
    order = np.argsort(keys)
    keys, toxic = keys[order], np.array([r["n"] for r in seen], np.float64)[order]
    clean = np.zeros(len(keys))
    for r in count(0, keys).collect():
        clean[np.searchsorted(keys, U(r["key"] & 0xFFFFFFFFFFFFFFFF))] = r["n"]
    odds = np.log((toxic + 0.5) / (n.get(1, 0) + 1)) - np.log((clean + 0.5) / (n.get(0, 0) + 1))
    good = np.flatnonzero(odds > 1.5)
    good = np.sort(good[np.argsort(-odds[good], kind="stable")][:LEXICON])
    return keys[good], odds[good]


def _per(doc: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weight, minlength=n).astype(np.float64)


def features(texts: pa.Array, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    buf, off = buffers(texts)
    n, keys, odds = len(off) - 1, *lexicon
    w = plain_words(buf, off)
    doc = w.doc()
    words = np.maximum(1.0, np.diff(w.at))
    base = _within(w.hash, hashes_of(BASE)) >= 0
    place = _within(w.hash, keys)
    best, hit, begin = np.zeros(len(doc)), place >= 0, np.zeros(len(doc))
    best[hit] = odds[place[hit]]
    for k in PREFIXES:
        of, h = beginnings(w, k)
        p = _within(h, keys)
        ok = p >= 0
        begin[of[ok]] = np.maximum(begin[of[ok]], odds[p[ok]])
    top = lambda x: np.maximum.reduceat(np.append(x, 0.0), np.minimum(w.at[:-1], len(x))) * (np.diff(w.at) > 0)
    second = _within(w.hash, hashes_of(SECOND)) >= 0
    bad = base | hit | (begin > 0)
    near = np.zeros(len(doc), bool)
    for d in range(1, SPAN + 1):
        same = doc[d:] == doc[:-d]
        near[d:] |= bad[d:] & second[:-d] & same
        near[:-d] |= bad[:-d] & second[d:] & same
    text_of = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off]).astype(np.float64)
    size = np.maximum(1.0, np.diff(off))
    letters, upper, sign = _letter[buf], (buf >= 0x41) & (buf <= 0x5A), _sign[buf]
    raw = Words(buf, off, NOT_SPACE)
    at_u, at_s, at_l = (np.concatenate([[0], np.cumsum(x)]) for x in (upper, sign | ((buf >= 0x30) & (buf <= 0x39)), letters))
    rdoc, long_ = raw.doc(), raw.end - raw.start >= 3
    shouted = long_ & (at_u[raw.end] - at_u[raw.start] >= 3) & (at_u[raw.end] - at_u[raw.start] == at_l[raw.end] - at_l[raw.start])
    ends = letters[np.maximum(raw.start, 0)] & long_ if len(rdoc) else long_
    inner = at_s[np.maximum(raw.end - 1, raw.start)] - at_s[raw.start] > 0
    obfuscated = ends & inner & (at_l[raw.end] - at_l[raw.start] >= 2)
    rwords = np.maximum(1.0, np.diff(raw.at))
    return np.stack(
        [
            np.log1p(np.diff(w.at)),
            _per(doc[base], n) / words,
            np.log1p(_per(doc[base], n)),
            _per(doc[hit], n) / words,
            np.log1p(_per(doc[hit], n)),
            top(best),
            _per(doc, n, best) / words,
            np.log1p(_per(doc[begin > 0], n)),
            top(begin),
            _per(doc[second], n) / words,
            _per(doc[near], n) / words,
            text_of(upper) / np.maximum(1.0, text_of(letters)),
            _per(rdoc[shouted], n) / rwords,
            text_of(buf == 0x21) / size,
            text_of(buf == 0x3F) / size,
            text_of(sign) / size,
            text_of((buf >= 0x30) & (buf <= 0x39)) / size,
            _per(rdoc[obfuscated], n) / rwords,
        ],
        1,
    )


class Boosted:
    """Logistic gradient boosting of small trees over binned features."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 1.0):
        self.n_trees, self.depth, self.rate, self.n_bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.n_bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        p = y.mean()
        self.start = float(np.log((p + 1e-6) / (1 - p + 1e-6)))
        score, self.trees = np.full(len(y), self.start), []
        for _ in range(self.n_trees):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            tree, node = [], np.zeros(len(y), np.int64)
            for level in range(self.depth):
                split = [self._best(b[at], g[at], h[at]) if len(at := np.flatnonzero(node == k)) else (-1, 0) for k in range(1 << level)]
                tree.append(split)
                node = self._down(b, node, split)
            n = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.least)
            self.trees.append((tree, leaf))
            score += leaf[node]
        return self

    def _best(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        total, weight, found = g.sum(), h.sum(), (1e-6, -1, 0)
        for f, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            gl, hl = (np.cumsum(np.bincount(b[:, f], v, len(cuts) + 1))[:-1] for v in (g, h))
            gain = gl**2 / (hl + self.least) + (total - gl) ** 2 / (weight - hl + self.least) - total**2 / (weight + self.least)
            k = int(gain.argmax())
            if gain[k] > found[0]:
                found = (float(gain[k]), f, k)
        return found[1:]

    @staticmethod
    def _down(b: np.ndarray, node: np.ndarray, split: list[tuple[int, int]]) -> np.ndarray:
        f, k = np.array([s[0] for s in split])[node], np.array([s[1] for s in split])[node]
        return 2 * node + ((f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > k))

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        score = np.full(len(x), self.start)
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for split in tree:
                node = self._down(b, node, split)
            score += leaf[node]
        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing fit of y by x, by pooling adjacent violators; y is drawn in from 0 and 1 by half a row."""
    order = np.argsort(x, kind="stable")
    xs, at = np.unique(x[order], return_index=True)
    n = np.diff(np.append(at, len(x))).astype(np.float64)
    s = np.add.reduceat(y[order].astype(np.float64), at)
    blocks: list[list[float]] = []
    for i in range(len(xs)):
        blocks.append([s[i], n[i], xs[i], xs[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    kx = np.array([v for b in blocks for v in b[2:]])
    ky = np.repeat([(b[0] + 0.5) / (b[1] + 1) if len(blocks) > 1 else b[0] / b[1] for b in blocks], 2)
    return kx, np.maximum.accumulate(ky)


class Model:
    def __init__(self, lexicon: tuple[np.ndarray, np.ndarray], trees: Boosted | None, knots: tuple[np.ndarray, np.ndarray] | None, share: float):
        self.lexicon, self.trees, self.knots, self.share = lexicon, trees, knots, share

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return np.interp(self.trees.raw(features(texts, self.lexicon)), *self.knots)


def _featured(lexicon: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                x = features(b.column("text"), lexicon)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0, most: int = TRAIN_ROWS) -> Model:
    """A model of labels.toxic; rows with crc32(doc_id) mod modulus = rest are not learned from."""
    with Scratch(docs.sparkSession) as own:
        return _learned(own.save(labelled_texts(docs, training_rows(labels, "toxic", modulus, rest, most)), "training"))


def _learned(texts: DataFrame) -> Model:
    """A model of the training rows (doc_id, text, y)."""
    lexicon = learn_lexicon(texts)
    got = texts.mapInArrow(_featured(lexicon), "doc_id long, y int, x array<double>").orderBy("doc_id", "x").toArrow()
    y = np.array(got["y"].to_numpy(), np.float64)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, None, float(y.mean()) if len(y) else 0.0)
    x = np.array(got["x"].combine_chunks().flatten()).reshape(len(y), -1)
    ids = np.array(got["doc_id"].to_numpy(), np.int64).view(U)
    for_scale = mix(ids) % U(5) == 0
    if len(set(y[for_scale])) < 2 or len(set(y[~for_scale])) < 2:
        for_scale = np.ones(len(y), bool)
    learned = ~for_scale if not for_scale.all() else for_scale
    trees = Boosted().fit(x[learned], y[learned])
    return Model(lexicon, trees, isotonic(trees.raw(x[for_scale]), y[for_scale]), float(y.mean()))


def _scored(model: Model, batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch, "text"):
            names = [x for x in b.schema.names if keep or x != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(model.score(b.column("text")))], [*names, "score"])


def toxicity(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text and others) with score; without text unless keep_text."""
    schema = StructType([x for x in docs.schema if keep_text or x.name != "text"]).add("score", "double")
    return docs.mapInArrow(lambda bs: _scored(model, bs, keep_text), schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = alone(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = toxicity(docs, fit(docs, alone(table(spark, sf_dir, "labels"), "doc_id", "toxic")))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
