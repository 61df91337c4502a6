from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.llm import brown, decontaminate, embed_dedup, line_dedup, minhash, mixing, passages, quality, toxicity, warc
from keelson.llm._graph import connected_components
from keelson.llm._shared import Scratch
from keelson.llm._text import ALNUM, NOT_SPACE, Words, buffers

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string, n_words long, hash string"
WORDS = [a + b for a in ("ka", "lo", "Mi", "né", "zu") for b in ("ra", "ti", "XO", "ße", "")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def prose(rng, n):
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def table(spark, rows):
    """rows: id, text[, source]; two more columns have names that operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", 7, "h") for r in rows], DOCS)


def fixture(seed=1, n=40):
    rng = np.random.default_rng(seed)
    rows = [(i, prose(rng, int(rng.integers(1, 80)))) for i in range(n)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    for i in range(12):  # near copies of one text, some of each other
        w = rows[3 + i % 3][1].split(" ") + prose(rng, 60).split(" ")[:40]
        w[int(rng.integers(0, len(w)))] = "other"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "One"), (304, "one"), (305, prose(rng, 9000)), (0, rows[0][1]), (None, rows[1][1]), (None, None)]
    return rows


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_words_equal_regular_expressions():
    texts = ["", "a  B\tç", "x" * 1000 + "\n" + "Y", "ß\x0b!a-1", "é" * 300_000 + " end"]
    for mask, pattern in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(*buffers(pa.array(texts)), mask)
        for i, t in enumerate(texts):
            got = [bytes(w.buf[s:e]).decode().translate(UP) for s, e in zip(w.start[w.at[i] : w.at[i + 1]], w.end[w.at[i] : w.at[i + 1]], strict=True)]
            assert got == re.findall(pattern, t.translate(UP))
    w = Words(*buffers(pa.array(["Ab aB ab Ba"])), NOT_SPACE)
    assert len(set(w.hash[:3].tolist())) == 1 and w.hash[3] != w.hash[0]


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    links = [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(45)] + [(i, i + 1) for i in range(70, 90)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark))
    assert {r["node"]: r["component"] for r in got.collect()} == components({x for a, b in links if a != b for x in (a, b)}, [x for x in links if x[0] != x[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).isEmpty()


def test_components_of_stars_take_no_round(spark):
    scratch = Scratch(spark)
    got = connected_components(spark.createDataFrame([(k % 3, k) for k in range(3, 60)] + [(5, 5)], "a long, b long"), scratch)
    assert sorted(map(tuple, got.collect())) == [(k, k % 3) for k in range(60)] and scratch.n == 1


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b", "x" * 5000), (2, None, "x" * 5000), (3, "u", None), (4, "u", ""), (None, "u", "ÿé\n"), (2, None, "x" * 5000), (5, "u", "P*M\x18\0\0\0\0"), (6, "u", "y" * 200_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "w")
    warc.write_archives(pages.repartition(2), path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(h or "" for i, _, h in rows if i == r["page_id"]).encode()
        sha = warc.digest(text)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text), sha)
        assert r["payload"] == (None if r["record_type"] == "revisit" else text)
    by = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert by[(2, "revisit", 1)] == 2 and by[(4, "revisit", 3)] == 1 and by[(None, "response", None)] == 1
    warc.write_archives(pages, path + "8", min_bytes=8)
    assert {r["record_type"] for r in warc.read_archives(spark, path + "8").where("page_id IN (3, 4)").collect()} == {"response"}
    warc.write_archives(pages.limit(0), path + "0")
    assert warc.read_archives(spark, path + "0").isEmpty()


def test_archives_are_standard_frames():
    import io

    import zstandard

    recs = [warc.record(i, "u", b"payload %d" % i * 99, "D", None, False) for i in range(30)]
    raw_dict = warc.train(recs)
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw_dict))
    raw = warc.struct.pack("<II", warc.DICT_MAGIC, len(raw_dict)) + raw_dict + b"".join(c.compress(r) + warc.GAP for r in recs)
    assert list(warc.records_of(raw)) == recs
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw_dict))
    assert d.stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(recs)
    with pytest.raises(ValueError):
        list(warc.records_of(raw[:-20]))


@pytest.mark.parametrize("n,percent", [(2, 80), (5, 80), (1, 50)])
def test_minhash_equals_all_pairs(spark, n, percent):
    rows = fixture()
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b for x in sets[a] for y in sets[b] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    comp = components(ids, links)
    out = minhash.near_duplicates(table(spark, rows), n, percent).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["component_id"] == (None if r["doc_id"] is None else comp[r["doc_id"]]) and r["kept"] == (r["doc_id"] is None or comp[r["doc_id"]] == r["doc_id"])
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    assert minhash.near_duplicates(table(spark, rows).limit(0)).isEmpty()


def test_minhash_equals_all_pairs_in_a_crowd(spark):
    rng = np.random.default_rng(22)
    has = np.zeros((900, 150 + 900 * 10), np.int32)  # most just below 0.8 of each other, a few pairs above
    for i in range(len(has)):
        has[i, :150] = 1
        has[i, rng.choice(150, 10, replace=False)] = 0
        has[i, 150 + 10 * i : 160 + 10 * i] = 1
    common = has @ has.T
    links = [(int(a), int(b)) for a, b in np.argwhere(100 * common >= 80 * (300 - common)) if a < b]
    comp = components(range(len(has)), links)
    assert 100 < len(links) and len(set(comp.values())) > 100
    rows = [(i, " ".join(f"w{k}" for k in np.flatnonzero(x))) for i, x in enumerate(has)]
    out = minhash.near_duplicates(table(spark, rows), 1, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == comp


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for size in (6, 40, 400):
        base = rng.integers(0, 2**63, size * 2).astype(np.uint64)
        got = []
        for _ in range(40):
            pool = rng.permutation(base)
            k = int(size * 1.8 / 2)
            x, y = np.sort(pool[:size]), np.sort(np.concatenate([pool[:k], pool[size : size + size - k]]))
            sig = minhash.signatures([x, y])
            got.append((sig[0] == sig[1]).mean() - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
        assert abs(np.mean(got)) < 0.08


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [(1, prose(rng, 30)), (2, prose(rng, 5)), (3, None), (4, "!!"), (5, prose(rng, 13)), (10, prose(rng, 20)), (2, prose(rng, 4)), (None, "a b")]
    rows = fixture(4, 20)
    rows += [(400, prose(rng, 9) + ". " + items[0][1].upper() + "; " + prose(rng, 4)), (401, items[1][1].replace(" ", "--")), (402, " ".join(items[0][1].split(" ")[:13]) + " " + prose(rng, 400) + " " + items[5][1])]
    for bits in (decontaminate.SPOTS, 7):  # with 128 bits, most shingles are let through
        out = decontaminate.verdicts(decontaminate.contaminated_spans(table(spark, rows), spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, words string"), bits=bits)).collect()
        assert len(out) == len(rows)
        want = collections.Counter()
        for i, t in rows:
            w = re.findall(pattern, (t or "").translate(UP))
            hit, found = set(), set()
            for item, u in items:
                v = re.findall(pattern, (u or "").translate(UP))
                m = min(13, len(v))
                wins = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m and item is not None else set()
                for k in range(len(w) - m + 1):
                    if tuple(w[k : k + m]) in wins:
                        hit |= set(range(k, k + m))
                        found.add(item)
            sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
            want[(i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))] += 1
        assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out) == want
    none = decontaminate.verdicts(decontaminate.contaminated_spans(table(spark, rows), spark.createDataFrame([], "item_id long, text string")))
    assert none.where("n_hit > 0").isEmpty() and none.count() == len(rows)


@pytest.mark.parametrize("bits", [8, 20])
def test_items_without_id_hit_words(spark, bits):
    item = " ".join(f"w{k}" for k in range(20))
    items = spark.createDataFrame([(None, item), (4, "one two three")], "item_id long, text string")
    docs = table(spark, [(1, f"a {item} b"), (2, "nothing here"), (3, "one two three")])
    out = decontaminate.verdicts(decontaminate.contaminated_spans(docs, items, bits=bits)).collect()
    assert {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in out} == {1: (20, 0, True), 2: (0, 0, False), 3: (3, 1, True)}


def test_lower_containment_finds_changed_windows(spark):
    rng = np.random.default_rng(8)
    w = [f"w{i}" for i in rng.permutation(60)]
    changed = list(w[:20])
    changed[6] = "zzz"
    docs, items = table(spark, [(1, " ".join(changed)), (2, " ".join(w[30:]))]), spark.createDataFrame([(9, " ".join(w[:13]))], "item_id long, text string")
    n = {t: {r["doc_id"]: r["n_hit"] for r in decontaminate.verdicts(decontaminate.contaminated_spans(docs, items, containment=t)).collect()} for t in (1.0, 0.9)}
    assert n == {1.0: {1: 0, 2: 0}, 0.9: {1: 13, 2: 0}}


def test_mixing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, int(rng.integers(1, 60))), f"s{i % 4}" if i % 9 else None) for i in range(900)] + [(1, prose(rng, 4000), "s1"), (5, None, "s1"), (5, "", "s1")] + [(7, "a b c", "s3")] * 20
    df = table(spark, rows)
    got = mixing.mix_sources(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    again = mixing.mix_sources(df.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert collections.Counter(got) == collections.Counter(again) and len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(sizes.values())
    free = set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        for s in full or free:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert taken[s] == pytest.approx(target[s], rel=0.02)
    assert mixing.mix_sources(df.limit(0)).isEmpty()


def test_pivotal_rounding_keeps_expectations(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 5)), "s") for i in range(40)] + [(99, "a " * 300, "t")]
    mean = collections.Counter()
    for seed in range(12):
        for r in mixing.mix_sources(table(spark, rows), share=0.9, seed=seed).where("source = 's'").collect():
            mean[r["doc_id"] % 2] += r["taken"]
    want = 12 * mixing.mix_sources(table(spark, rows), share=0.9).where("source = 's'").first()["target"]
    assert sum(mean.values()) == pytest.approx(want, rel=0.05)


def test_embeddings_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 16))
    x[50:130] = x[0] + rng.normal(size=(80, 16)) * 0.12
    x[130:140] = x[1]
    x[140:150] = x[2] * 3.5
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, rows[3][1]), (4, rows[4][1])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, unit string")
    out = embed_dedup.embedding_near_duplicates(df).collect()
    assert len(out) == len(rows)

    def usable(v):
        return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    u = [np.array(v) / np.linalg.norm(v) if usable(v) else None for _, v in rows]
    link = [[a is not None and b is not None and i != j and len(a) == len(b) and a @ b >= 0.95 for j, b in enumerate(u)] for i, a in enumerate(u)]
    comp = components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if link[i][j]])
    low = {c: min([rows[i][0] for i in comp if comp[i] == c and rows[i][0] is not None], default=None) for c in set(comp.values())}
    want = collections.Counter((r[0], sum(link[i]), None if r[0] is None else low[comp[i]]) for i, r in enumerate(rows))
    assert collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == want
    assert embed_dedup.embedding_near_duplicates(df.limit(0)).isEmpty()


def test_embeddings_equal_all_pairs_in_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "WINDOW", 2)  # as short beside a key as 24 are beside keys of larger tables
    rng = np.random.default_rng(23)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    base, d = unit(rng.normal(size=(1, 128))), 128
    x = unit(np.sqrt(0.9) * base + np.sqrt(0.1) * unit(rng.normal(size=(1500, d))))  # cosine about 0.9
    x = np.concatenate([x, unit(x[:120] + 0.2 * unit(rng.normal(size=(120, d))))])  # and pairs of about 0.98
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    comp = components(range(len(x)), list(zip(i.tolist(), j.tolist(), strict=True)))
    assert len(i) >= 120 and len(set(comp.values())) > 1000
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.embedding_near_duplicates(df).collect()}
    n = np.bincount(np.concatenate([i, j]), minlength=len(x))
    wrong = [k for k in out if out[k] != (n[k], comp[k])]
    assert not wrong, f"{len(wrong)} of {len(x)}"


def labelled(rng, n, mark):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        t = prose(rng, int(rng.integers(5, 60)))
        rows.append((i, mark(t, rng) if bad else t))
        labels.append((i, int(not bad), int(bad)))
    return rows, labels


EDGES = [(9000, None), (9001, ""), (9002, "x" * 300_000), (None, "one two"), (3, "again")]


def test_quality_learns_and_scores_all_rows(spark):
    rows, labels = labelled(np.random.default_rng(9), 400, lambda t, r: " ".join([t.split(" ")[0].upper() + "!!"] * 20))
    lab = spark.createDataFrame([*labels, (5, None, None), (6, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    df = table(spark, rows + EDGES)
    m = quality.fit(df, lab)
    got = {}
    for r in quality.quality(df, m).collect():
        assert 0 <= r["score"] <= 1
        got.setdefault(r["doc_id"], r["score"])
    held = [i for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == bool(labels[i][1]) for i in held]) > 0.95
    assert len(got) == len(rows) + 4
    none = quality.fit(df, lab.limit(0))
    assert {r["score"] < 1e-6 for r in quality.quality(df, none).collect()} == {True}


def test_toxicity_learns_and_scores_all_rows(spark):
    def mark(t, rng):
        w = t.split(" ")
        w.insert(int(rng.integers(0, len(w))), ("blurgh", "Idiot", "bl.urgh")[int(rng.integers(0, 3))])
        return " ".join(w)

    rows, labels = labelled(np.random.default_rng(10), 600, mark)
    df, lab = table(spark, rows + EDGES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.fit(df, lab)
    out = toxicity.toxicity(df, m).collect()
    got = {r["doc_id"]: r["score"] for r in out}
    assert len(out) == len(rows) + len(EDGES) and all(0 <= s <= 1 for s in got.values())
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0 and i != 3]
    assert np.mean([(got[i] >= 0.5) == bool(labels[i][2]) for i in held]) > 0.95
    assert toxicity.toxicity(df, toxicity.fit(df, lab.limit(0))).where("score <> 0").isEmpty()


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(11)
    x = rng.integers(0, 30, 500).astype(float)
    y = (rng.random(500) < x / 40).astype(float)
    kx, ky = toxicity.isotonic(x, y)
    assert (np.diff(kx) >= 0).all() and (np.diff(ky) >= 0).all()
    assert abs(np.interp(x, kx, ky).mean() - y.mean()) < 0.02


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup_equals_brute_force(spark, least):
    lines = ["Common line", " common LINE\t", "b", "", "É", "é", "rare"]
    rng = np.random.default_rng(12)
    rows = [(i, "\n".join(lines[int(rng.integers(0, k))] for _ in range(int(rng.integers(1, 12)))) + f"\nown {i}") for i, k in enumerate([7] * 30)]
    rows += [(50, None), (51, ""), (52, "b\n" * 20), (0, rows[0][1]), (0, "b\r\n\nx"), (None, "b"), (60, "\n".join(f"u{i}" for i in range(3000)) + "\nb")]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    seen = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add((i, None if i is not None else t))
    gone = {k for k, v in seen.items() if k and len(v) >= least}
    want = collections.Counter()
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if key(x) not in gone]
        want[(i, len(ls), len(ls) - len(kept), "\n".join(kept) if len(kept) < len(ls) else t)] += 1
    out = line_dedup.line_dedup(table(spark, rows), 1, least)
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == want
    assert set(DOCS.replace(",", "").split()[::2]) <= set(out.columns)
    assert line_dedup.line_dedup(table(spark, rows).limit(0), 1, least).isEmpty()


def test_first_occurrences_stay(spark):
    rows = [(2, "a\nb\na"), (1, "b\nc"), (3, "A \n\n\nd")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got == {1: "b\nc", 2: "a", 3: "\n\nd"}


def test_class_scores(spark):
    rng = np.random.default_rng(13)
    a, b = WORDS[:12], WORDS[12:]
    rows = [(i, " ".join((a, b)[i % 2][int(k)] for k in rng.integers(0, 12, 40))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "unseen Unseen"), (None, "ka lo"), (0, "ka")]
    df = table(spark, rows)
    out_ = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    got = brown.class_scores(df, df.where(~out_)).collect()
    train = [[*words(t), 0] for i, t in rows if i is None or i % 7 != 2]
    c = collections.Counter(x for t in train for x in t)
    n, v = sum(c.values()), len(c)
    want = collections.defaultdict(list)
    for i, t in rows:
        w = [*words(t), 0]
        want[i].append((len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    assert len(got) == len(rows)
    for r in got:
        assert r["train_tokens"] == n and any((r["n_tokens"], r["n_known"]) == x[:2] and r["base_score"] == pytest.approx(x[2]) for x in want[r["doc_id"]])
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 7 == 2 and r["doc_id"] < 300]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)
    assert brown.class_scores(df.limit(0), df.limit(0)).isEmpty()
    assert {r["base_score"] for r in brown.class_scores(df.limit(2), df.limit(0)).collect()} == {0.0}


def test_class_probabilities_sum_to_no_more_than_one(spark):
    rng = np.random.default_rng(14)
    df = table(spark, [(i, prose(rng, 30)) for i in range(50)])
    m, _ = brown.fit(df, Scratch(spark))
    assert np.allclose((10**m.transition).sum(1), 1)
    for k in range(brown.CLASSES):
        assert (m.count[m.cls == k] + 1).sum() <= m.size[k] + 1


def test_class_scores_equal_their_formula(spark):
    rng = np.random.default_rng(51)
    rows = [(i, prose(rng, int(rng.integers(1, 60)))) for i in range(120)]
    df = table(spark, [*rows, (500, "unseen " + rows[0][1] + " Unseen"), (501, None), (502, "zz")])
    m, _ = brown.fit(df.where("doc_id < 100"), Scratch(spark))
    texts = {i: t or "" for i, t in [*rows, (500, "unseen " + rows[0][1] + " Unseen"), (501, None), (502, "zz")]}
    of = {}
    for w in {x for t in texts.values() for x in words(t)}:
        one = Words(*buffers(pa.array([w])), NOT_SPACE)
        at = np.flatnonzero(m.words == one.hash[0])
        of[w] = (int(m.cls[at[0]]), int(m.count[at[0]])) if len(at) else (int(m.of_suffix[brown._suffix(one)[0]]), 0)
    got = {r["doc_id"]: r["score"] for r in brown.class_scores(df, df.where("doc_id < 100")).where("doc_id < 120 OR doc_id >= 500").collect()}
    for i, t in texts.items():
        last, total = brown.CLASSES, 0.0
        for w in words(t):
            c, n = of[w]
            total += m.transition[last, c] + math.log10((n + 1) / (m.size[c] + 1))
            last = c
        assert got[i] == pytest.approx(total + m.transition[last, brown.CLASSES]), i


def test_quality_forward_pass_and_step(spark):
    text = "Red fox red fox red"
    rows = [quality.counted(pa.array([text]))[0], quality.counted(pa.array(["über uns"]))[0]]
    w = Words(*buffers(pa.array([text])), NOT_SPACE, fold=False)
    bigrams = [quality.mix(w.hash[i : i + 1] * quality._mult[7] + w.hash[i + 1 : i + 2])[0] >> quality.U(64 - quality.BITS) for i in range(4)]
    got = dict(zip(rows[0][0].tolist(), rows[0][1].tolist(), strict=True))
    assert all(got[int(b)] >= 1 for b in bigrams) and sum(got.values()) >= 5 + 4 + 2
    m = quality.train([(1, f, n.astype(np.float32)) for f, n in rows[:1] * 20] + [(0, f, n.astype(np.float32)) for f, n in rows[1:] * 20])
    for (f, n), t in zip(rows, (text, "über uns"), strict=True):
        z = m.bias + float((m.share[f].astype(float) * n).sum() / n.sum())
        assert m.score(pa.array([t]))[0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
    a, b = m.score(pa.array([text, "über uns"]))
    assert a > 0.5 > b


def test_rare_words_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(15)
    rows = [(i, prose(rng, 30) + f" own{i % 20}") for i in range(60)]
    df = table(spark, rows)
    whole = {r["doc_id"]: (r["n_known"], round(r["base_score"], 9)) for r in brown.class_scores(df, df).collect()}
    monkeypatch.setattr(brown, "HEAD", 5)
    assert whole == {r["doc_id"]: (r["n_known"], round(r["base_score"], 9)) for r in brown.class_scores(df, df).collect()}


def test_exchange_separates_words_that_never_meet():
    n = np.zeros((10, 10))
    n[:4, :4], n[4:8, 4:8] = 5, 5
    cls, _ = brown.exchange(n, classes=2)
    assert len(set(cls[:4])) == len(set(cls[4:])) == 1 and cls[0] != cls[4]


def test_compact_windows_equal_the_tree():
    rng = np.random.default_rng(16)
    for t in range(20):
        at = np.concatenate([[0], np.cumsum(rng.integers(0, 90, 4))])
        h = rng.integers(0, 2**63, at[-1]).astype(np.uint64)
        if t % 3 == 0:
            h = h[rng.integers(0, len(h), len(h))]
        for f, (_, of, lo, c, hi) in enumerate(passages.compact_windows(h, at, 20)):
            want = set()
            for d in range(4):
                v = [int(x) * int(passages._odd[f]) % 2**64 for x in h[at[d] : at[d + 1]]]
                todo = [(0, len(v) - 1)]
                while todo:
                    a, b = todo.pop()
                    if b - a + 1 >= 20:
                        m = min(range(a, b + 1), key=lambda i: (v[i], i))
                        want.add((d, a, m, b))
                        todo += [(a, m - 1), (m + 1, b)]
            assert set(zip(of.tolist(), lo.tolist(), c.tolist(), hi.tolist(), strict=True)) == want


def test_passages_with_a_word_changed_anywhere_are_alike():
    rng = np.random.default_rng(21)
    fresh = iter(range(10**9))
    seq = lambda w: passages.shingles(Words(*buffers(pa.array([" ".join(w)])), NOT_SPACE), passages.GRAM)[0]
    text = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    for n in range(50, 76, 5):
        p = text(n)
        for k in range(n):
            near = p[:k] + ["changed"] + p[k + 1 :]
            x, y = text(30) + p + text(30), text(int(rng.integers(0, 40))) + near + text(9)
            a, b = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (p, near))
            found = passages.alike(seq(x), seq(y))
            assert 5 * len(a & b) >= 4 * len(a | b) or not found
            if 5 <= k < n - 5 and 5 * len(a & b) >= 4 * len(a | b):
                assert [(s, e) for s, e, *_ in found] == [(30, 30 + n - 4)], (n, k)
    two = p[:20] + p[10:40]  # places of its own words that are also elsewhere
    assert passages.alike(seq(text(5) + p), seq(two + text(20) + p + two))[0][:2] == (5, 5 + len(p) - 4)


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rng = np.random.default_rng(17)
    fresh = iter(range(10**9))
    text = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    p = text(60)
    near = list(p)
    near[30] = "changed"
    rows = {i: text(200) for i in range(20)}
    for i, x in ((3, p), (5, p), (7, near), (11, p)):
        at = int(rng.integers(0, 150))
        rows[i][at:at] = x
    rows[15] = rows[14]
    docs = [(i, " ".join(w)) for i, w in rows.items()] + [(30, None), (31, ""), (32, "a b"), (None, " ".join(p)), (3, " ".join(rows[3])), (40, "the " * 5000)]
    out = passages.repeated_passages(table(spark, docs).repartition(3)).collect()
    assert {x for r in out for x in (r["doc_id"], r["other_doc_id"])} == {3, 5, 7, 11, 14, 15}
    for r in out:
        assert r["similarity"] >= 0.8
        if r["similarity"] == 1:
            assert rows[r["doc_id"]][r["start_word"] : r["end_word"]] == rows[r["other_doc_id"]][r["other_start_word"] : r["other_end_word"]]
    assert any((r["doc_id"], r["other_doc_id"]) == (15, 14) and r["end_word"] - r["start_word"] == 200 for r in out)
    assert passages.repeated_passages(table(spark, docs).limit(0)).isEmpty()


def test_edited_passages_of_a_crowd_are_of_one_class_where_they_are_alike(spark):
    """Texts that say one template, each with a word of its own anywhere, of which every second one differs from the one before by one word more: few are like any one of them."""
    rng = np.random.default_rng(400)
    text = lambda i, k: [f"f{i}_{k}_{j}" for j in range(int(rng.integers(0, 60)))]
    said, rows = [], []
    for i in range(240):
        w = said[-1].copy() if i % 2 else [f"t{k}" for k in range(60)]
        w[30 if i % 2 else int(rng.integers(0, 60))] = f"own{i}"
        said.append(w)
        rows.append((i, " ".join(text(i, 0) + w + text(i, 1))))
    sets = [{tuple(w[k : k + 5]) for k in range(56)} for w in said]
    pairs = [(i, j) for i in range(240) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    of = {}
    for r in passages.repeated_passages(table(spark, rows).repartition(3)).collect():
        assert r["similarity"] >= 0.8
        of[r["doc_id"]] = of[r["other_doc_id"]] = r["class_id"]
    assert sum(i in of and of[i] == of.get(j) for i, j in pairs) >= 0.97 * len(pairs)
    # a tree of ways: rows 1 and 2 leave the rest at one token, and 3 one later
    way = [[1, 2, 3, 4], [1, 2, 5, 0], [1, 2, 6, 0], [1, 2, 3, 7], [1, 2, 3, 4]]
    order = sorted(range(5), key=lambda k: way[k])
    lcp = [0] + [next((k for k in range(4) if way[a][k] != way[b][k]), 4) for a, b in itertools.pairwise(order)]
    found = [{order[k] for k in own.tolist()} for _, own in passages._light(lcp, np.array(order))]
    assert {1, 2} <= found[-1] and 3 in found[-1] and any(3 in x and 1 not in x for x in found) and {0, 4} in found


def test_plain_verification_is_that_of_alike():
    rng = np.random.default_rng(5)
    text = lambda n: rng.integers(0, 2**31, n).astype(np.int32)
    a, b = [], []
    for t in range(300):
        p = text(int(rng.integers(0, 120)))
        q = p.copy()
        for _ in range(t % 3 if len(p) else 0):
            q[int(rng.integers(0, len(q)))] = 7
        a.append(np.concatenate([text(t % 20), p, p[5:18] if t % 11 == 0 else p[:0], text(t % 7)]))
        b.append(np.concatenate([text(t % 30), q, q[5:18] if t % 7 == 0 else q[:0]]))
    lists = lambda x: pa.array([v.tolist() for v in x], pa.list_(pa.int32()))
    n, zero = pa.array(np.arange(300)), pa.array(np.zeros(300, np.int64))
    rows = next(passages._verified(iter([pa.RecordBatch.from_arrays([n, n, zero, zero, lists(a), lists(b)], ["a", "b", "lo_a", "lo_b", "seq_a", "seq_b"])]))).to_pylist()
    got = sorted((r["doc_id"], r["start_word"], r["end_word"] - 4, r["other_start_word"], r["other_end_word"] - 4, r["similarity"]) for r in rows)
    assert got and got == sorted((i, *f) for i in range(300) for f in passages.alike(passages._tokens(a[i]), passages._tokens(b[i])))


def test_verification_takes_the_runs_of_a_pair_at_once():
    """As many calls for 200 runs of common tokens as for 40, and the passages that sets of all pairs of runs give."""
    rng = np.random.default_rng(8)

    def pair(runs, other, words):
        x, y, at = [], [], []
        for _ in range(runs):
            run = rng.integers(0, words, int(rng.integers(3, 14))).astype(np.uint64)
            at.append((len(x), len(x) + len(run), len(y), len(y) + len(run)))
            x += [*run, *rng.integers(1 << 40, 1 << 41, int(rng.integers(1, other)), dtype=np.uint64)]
            y += [*run, *rng.integers(1 << 41, 1 << 42, int(rng.integers(1, other)), dtype=np.uint64)]
        return np.array(x, np.uint64), np.array(y, np.uint64), at

    def calls(runs):
        x, y, _ = pair(runs, 4, 1 << 30)
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(event))
        try:
            passages.alike(x, y)
        finally:
            sys.setprofile(None)
        return len(seen)

    assert calls(200) < 1.5 * calls(40)
    some = 0
    for t in range(60):
        x, y, at = pair(12, 2 + t % 2, 1 << 30)
        want, end = [], -1
        for i, (s, _, s2, _) in enumerate(at):
            for _, e, _, e2 in reversed(at[i:]):
                a, b = set(x[s:e].tolist()), set(y[s2:e2].tolist())
                if min(e - s, e2 - s2) >= 41 and max(e - s, e2 - s2) >= 46 and 5 * len(a & b) >= 4 * len(a | b):
                    want += [(s, e, s2, e2, len(a & b) / len(a | b))] if e > end else []
                    end = max(end, e)
                    break
        assert passages.alike(x, y) == want
        some += len(want) > 0
    assert 10 < some < 60


def test_rows_to_be_linked_are_read_as_they_were_packed(spark):
    doc, at = np.array([5, -3, 1 << 60, 0]), np.array([7 << 20, 1 << 50, 0, 3])
    p, ctx = np.array([-1, 1, -(1 << 62), 9]), np.array([-1, 0, 1 << 30, 2], np.int32)
    for turn in (0, 2):
        heads, made = passages._rows(p, doc, at, ctx, turn), passages._rows(p, doc, at, ctx, turn, doc + 1, at - 4)
        both = pa.Table.from_batches([heads, made, heads]).combine_chunks().to_batches()[0]
        rows, links = passages._read(both)
        assert [x.tolist() for x in rows] == [[*x.tolist()] * 2 for x in (p, doc, at, ctx)]
        assert [x.tolist() for x in links] == [x.tolist() for x in (p, doc, at, ctx, doc + 1, at - 4)]
    rows = passages._rows(np.zeros(4, np.int64), doc, at, ctx, 0).to_pylist()
    got = spark.createDataFrame([(r["row"],) for r in rows], "row binary").sort("row").collect()
    assert [bytes(r["row"]) for r in got] == [rows[k]["row"] for k in np.argsort(doc)]


def test_repeated_runs_are_all_inside_passages(spark):
    """Every run of 50 words that two documents hold, of texts made of a few shared lines and passages, some common to most."""
    rng = np.random.default_rng(31)
    fresh = iter(range(10**9))
    text = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    parts = [text(int(n)) for n in rng.integers(12, 90, 14)]
    rows = []
    for i in range(120):
        w = text(int(rng.integers(0, 60)))
        for _ in range(int(rng.integers(0, 4))):
            w += parts[int(rng.integers(0, 14)) if rng.random() < 0.7 else 0] + text(int(rng.integers(0, 30)))
        rows.append((i, " ".join(w)))
    runs, of = collections.defaultdict(set), {}
    for i, t in rows:
        of[i] = w = t.split()
        for k in range(len(w) - 49):
            runs[tuple(w[k : k + 50])].add(i)
    out = passages.repeated_passages(table(spark, rows).repartition(5)).collect()
    spans = collections.defaultdict(list)
    for r in out:
        spans[r["doc_id"]].append((r["start_word"], r["end_word"], r["class_id"]))
        spans[r["other_doc_id"]].append((r["other_start_word"], r["other_end_word"], r["class_id"]))
        x, y = of[r["doc_id"]][r["start_word"] : r["end_word"]], of[r["other_doc_id"]][r["other_start_word"] : r["other_end_word"]]
        x, y = ({tuple(v[k : k + 5]) for k in range(len(v) - 4)} for v in (x, y))
        assert r["similarity"] == pytest.approx(len(x & y) / len(x | y)) and r["similarity"] >= 0.8
        assert r["doc_id"] != r["other_doc_id"] and r["class_id"] <= r["other_doc_id"]
    for i, w in of.items():
        for k in range(len(w) - 49):
            if len(runs[tuple(w[k : k + 50])]) > 1:
                assert any(s <= k and k + 50 <= e for s, e, _ in spans[i]), (i, k)
    for docs in runs.values():  # what shares a run shares a class
        if len(docs) > 1:
            assert len(set.intersection(*({c for *_, c in spans[i]} for i in docs))) > 0


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rng = np.random.default_rng(18)
    fresh = iter(range(10**9))
    text = lambda n: " ".join(f"w{next(fresh)}" for _ in range(n))
    item = text(20)
    rows = [(i, text(40) + "\nshared line\n" + text(5)) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(5)] + [(200, item + " " + text(9)), (300, None), (301, ""), (302, "shared line")]
    rows += [(400 + i, text(20) + " idiot " + text(9)) for i in range(80)]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 400)) for i, _ in rows if i < 60 or i >= 400], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == list(P.COLUMNS)
    assert set(kept["toxicity"]) == {i for i, _ in rows if i < 400}
    assert "shared line" not in "".join(r["text"] or "" for r in kept["line_dedup"].values()) and kept["line_dedup"][302]["text"] == "" and kept["line_dedup"][300]["text"] is None
    assert set(kept["minhash_near_dedup"]) == set(kept["toxicity"]) - {100, 101, 102, 103, 104}
    assert set(kept["decontamination"]) == set(kept["minhash_near_dedup"]) - {200}
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and all(r["taken"] == r["copies"] * r["size"] for r in kept["mixing"].values())
    assert set(P.run(spark, sf).select("doc_id").toPandas()["doc_id"]) == set(kept["mixing"])


def test_minhash_takes_rows_of_one_id_as_one_node(spark):
    t, u = prose(np.random.default_rng(41), 40), prose(np.random.default_rng(42), 40)
    rows = [(3, u), (5, t), (5, u), (9, t), (11, None), (11, t), (12, "")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (11, 3, False), (12, 12, True)}


def test_line_bitmaps_of_a_very_long_text(spark):
    common = "\n".join(f"line {i % 7}" if i % 3 else f"own {i}" for i in range(200_000))
    rows = [(i, common if i == 0 else "\n".join(f"line {k}" for k in range(7))) for i in range(3)]
    df = table(spark, rows)
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(df, 1, 3).collect()}
    assert out[0]["n_lines"] == 200_000 and out[0]["text"] == "\n".join(x for x in common.split("\n") if x.startswith("own"))
    assert out[1]["text"] == out[2]["text"] == "" and out[1]["n_dropped"] == 7
    packed = line_dedup.keep_bitmaps(df.select("doc_id", "text"), Scratch(spark), 1, 3).where("doc_id = 1").first()["keep"]
    assert bytes(packed) == bytes([0, 0, 0, 0, 0, 0, 0, 7])


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    import corpus_pipeline as P

    rng = np.random.default_rng(43)
    fresh = iter(range(10**9))
    text = lambda n: " ".join(f"w{next(fresh)}" for _ in range(n))
    item, t, u = text(20), text(40), text(40)
    rows = [(3, u), (5, t), (5, u), (9, t), (9, t), (20, item), (20, text(30)), (None, item), (None, text(25)), (None, None), (30, None), (31, "")]
    # toxic and clean texts of one length, so that only the word tells
    rows += [(100 + i, text(20) + (" idiot " if i % 4 == 0 else f" {text(1)} ") + text(9)) for i in range(400)] + [(40, text(20) + " idiot " + text(9)), (40, text(30))]
    sf = str(tmp_path)
    spark.createDataFrame([(i, x, "en", f"s{k % 3}", len(x or ""), "clash") for k, (i, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        kept[name] = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert [i for i, x in kept["toxicity"] if "idiot" in (x or "")] == [] and sum(i == 40 for i, _ in kept["toxicity"]) == 1
    near = kept["minhash_near_dedup"]
    assert near[(3, u)] == 1 and near[(5, t)] == 1 and not near[(5, u)] and not near[(9, t)]
    assert near[(20, item)] == 1 and not near[(None, item)] and near[(None, None)] == 1 and near[(30, None)] == 1 and near[(31, "")] == 1
    clean = kept["decontamination"]
    assert not any(x == item for _, x in clean) and clean[(20, rows[6][1])] == 1 and clean[(None, rows[8][1])] == 1
    assert collections.Counter((r["doc_id"], r["text"]) for r in P.run(spark, sf).collect()) == kept["mixing"]
    empty = f"{sf}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert P.run(spark, empty).isEmpty()


def test_archives_are_bounded_and_each_opens_with_its_dictionary(spark, tmp_path):
    rng = np.random.default_rng(61)
    pages = [(i, f"http://x/{i}", prose(rng, 40) if i % 9 else None) for i in range(500)] + [(900, "http://x/long", "x" * 50_000), (None, "http://x/none", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    for frames, most in ((40, 1 << 30), (100, 4_000), (2, 1 << 30)):
        path = f"{tmp_path}/{frames}"
        warc.write_archives(df, path, frames=frames, most=most)
        raws = [p.read_bytes() for p in sorted((tmp_path / str(frames)).glob("part-*"))]
        assert len(raws) >= len(pages) // frames and all(r[:4] == warc.struct.pack("<I", warc.DICT_MAGIC) for r in raws if r)
        counts = [len(list(warc.records_of(r))) for r in raws]
        assert sum(counts) == len(pages) and max(counts) < frames
        got = {(r["page_id"], r["url"], r["payload_bytes"]) for r in warc.read_archives(spark, path).collect()}
        assert got == {(i, u, len((h or "").encode())) for i, u, h in pages}


SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_warc": ["page_id long", "payload_bytes long", "payload_digest string", "record_type string", "refers_to long"],
    "op2_minhash": ["doc_id long", "n_shingles long", "component_id long", "kept boolean"],
    "op3_quality": ["doc_id long", "held_out boolean", "score double", "predicted int"],
    "op4_decontamination": ["doc_id long", "n_words long", "n_hit long", "n_items long", "items_sha256 string", "contaminated boolean"],
    "op5_mixing": ["doc_id long", "size long", "source_size long", "target double", "taken long"],
    "op6_embedding_dedup": ["vec_id long", "n_links long", "component_id long", "kept boolean"],
    "op7_toxicity": ["doc_id long", "held_out boolean", "score double", "predicted int"],
    "op8_line_dedup": ["doc_id long", "n_lines long", "n_dropped long", "kept_sha256 string"],
    "op9_class_lm": ["doc_id long", "held_out boolean", "n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double"],
    "op10_passages": ["doc_id long", "other_doc_id long", "class_id long"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_its_columns_and_equals_its_sql(spark, name):
    from keelson.llm import catalog

    df = catalog.queries()[name](spark, SF)
    kinds = {c: {"bigint": "long"}.get(t, t) for c, t in df.dtypes}
    assert [f"{c.split()[0]} {kinds[c.split()[0]]}" for c in COLUMNS[name]] == COLUMNS[name]
    got = df.collect()
    assert len(got) > 0 and (name == "op10_passages" or len({r[0] for r in got}) == len(got))
    folds = {"op3_quality": (3, 1), "op7_toxicity": (5, 0), "op9_class_lm": (7, 2)}
    if name in folds:
        modulus, rest = folds[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in got)
    if name in ("op3_quality", "op7_toxicity"):
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    if sql := catalog.oracle_sql().get(name):
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(sql)
        assert collections.Counter(tuple(r[c] for c in want.columns) for r in got) == collections.Counter(want.fetchall())
