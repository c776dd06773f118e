"""Lexical search, SimHash and conversation repair against plain loops, and on nulls, empties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import pytest
import xxhash
from pyspark.sql import functions as F

from meterfold.llm import conversation_repair, lexical_search, queries, simhash

ODD = [(0, None), (1, ""), (2, " \n"), (3, "Tiny"), (4, "Don't  STOP now… ÀÉ é漢字_x9"), (5, "a" * 300 + " the" * 90), (6, "the alpha beta gamma"), (6, "the alpha beta gamma"), (None, "alpha null key"), (None, "alpha null key"), (7, "x\x1cy z \x00 the")]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(vocabulary, weights=[60 / (i + 1) for i in range(60)], k=rng.randint(1, 60))) for _ in range(150)]
    near = [f"{base[3]} {w}" for w in vocabulary[:10]] + [base[4]] * 5
    return ODD + [(100 + i, t) for i, t in enumerate(base + near)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Those texts with more columns, whose names clash with the operators' own."""
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for name in ("key", "data", "n", "ids", "item", "node", "least", "fingerprint", "score", "conv"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(rows, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in rows]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for i, own in asked.items():
        scored = []
        for d, c in counts:
            m = 100 - 90 + (90 * c.total() * n_docs) // total
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out |= {(i, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("p", [lexical_search.Params(), lexical_search.Params(k=3, block_terms=4, chunk_entries=60, leaf=2, piece=16)])
def test_search_is_that_of_plain_loops(spark, docs, texts, p):
    items = [(0, "w1 w5 w50 w50 nowhere"), (1, "The ALPHA x9 é漢字"), (1, "gamma"), (2, None), (3, "?!"), (None, "alpha w40"), (4, "w0"), (5, "nowhere")]
    found = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), p)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, found.collect())) == sorted(f"Row(item_id={i}, rank={r}, doc_id={d}, score={s})" for i, r, d, s in ranked(texts, items, p.k))


def test_search_of_empty_tables(spark, docs):
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(no_docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert lexical_search.search(docs, no_items).count() == 0


def test_terms_of_long_texts_come_piece_by_piece():
    text = ("word " * 50 + "x" * 300 + ";" + "Y1 " * 7).encode()
    for piece in (1, 7, 64, 10_000):
        assert lexical_search.term_counts(text, piece) == Counter(t.encode() for t in terms(text.decode()))


def test_a_subtree_bounds_the_scores_below_it():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 9, 80)
    ids = np.concatenate([np.sort(rng.choice(12, s, replace=False)) for s in sizes])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    tree = lexical_search.Tree(ids, rng.integers(1, 5, len(ids)), offsets, rng.integers(10, 200, 80), list(range(80)), 12)
    items = lexical_search.Items(np.arange(12), np.array([0, 3, 7, 12]), rng.integers(1, 900, 12))
    every = np.arange(3)
    stack, leaves = [(0, 80)], 0
    while stack:
        lo, hi = stack.pop()
        bound = items.scores(tree.maxima(lo, hi), tree.m[lo:hi].min(keepdims=True), every)[0]
        assert (items.scores(tree.dense(lo, hi), tree.m[lo:hi], every) <= bound).all()
        if hi - lo > 1:
            parts = tree.children(lo, hi, 1)
            assert [a for a, _ in parts] + [hi] == [lo] + [b for _, b in parts] and len(parts) > 1
            stack += parts
        else:
            leaves += 1
    assert leaves == 80


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance=3):
    """Smallest place that links reach, for each fingerprint."""
    out = list(range(len(prints)))
    for start in range(len(prints)):
        if out[start] != start:
            continue
        todo = [start]
        while todo:
            i = todo.pop()
            for j in range(len(prints)):
                if out[j] == j and j > start and (prints[i] ^ prints[j]).bit_count() <= distance:
                    out[j] = start
                    todo.append(j)
    return out


def test_simhash_is_that_of_plain_loops(docs, texts):
    prints = [plain_fingerprint(t) for _, t in texts]
    reach = classes(prints)
    least = {}
    for (d, _), c in zip(texts, reach, strict=True):
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    want = [(d, f"{f:016x}", least[c]) for (d, _), f, c in zip(texts, prints, reach, strict=True)]
    assert len(set(reach)) < len(texts) - 10
    for p in (simhash.Params(), simhash.Params(blocks=4, shingles=3, piece=9, block_rows=2)):
        assert sorted(map(str, map(tuple, simhash.near_duplicates(docs, p).collect()))) == sorted(map(str, want))


def test_close_fingerprints_meet_whatever_bits_differ(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = list({b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 3, 4, 5) for _ in range(4)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s,) for s in signed], "node long")
    for blocks in (4, 5, 6):
        linked = {r.node: r.component for r in simhash.components(simhash.close_edges(nodes, simhash.Params(blocks=blocks, block_rows=8))).collect()}
        own = classes(prints)
        together = lambda labels: sorted(sorted(s for s, x in zip(signed, labels, strict=True) if x == c) for c in set(labels))
        assert together(own) == together([linked.get(s, s) for s in signed])


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def faults_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, rows) by trying every edit; text is sought among all audits, not step by step among the least."""

    @lru_cache(None)
    def best(i, written, spare):
        options = []
        if i == len(rows) and (written in "" or re.fullmatch("s?(ua)+", written)):
            options.append((0, "", ()))
        if spare:
            for x in "ua":
                if re.fullmatch("s?((ua)*u?)", written + x):
                    c, a, r = best(i, shorter(written + x), spare - 1)
                    options.append((c + 2, "I" + a, ((x, ""),) + r))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, written, 2)
            options.append((c + 3, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                for letter, x, cost, own in [("K", role[:1], 0, role), ("R", "u", 2, "u"), ("R", "a", 2, "a")]:
                    if x and re.fullmatch("s?((ua)*u?)", written + x):
                        c, a, r = best(i + 1, shorter(written + x), 2)
                        options.append((c + cost + late, letter + a, ((own, text),) + r))
        return min(options, default=(10**9, "", ()))

    def shorter(w):
        # what has been written matters by its form only
        return w if len(w) < 4 else ("s" if w[0] == "s" else "") + ("ua" if w[-1] == "a" else "uau")

    cost, audit, out = best(0, "", 2)
    return cost, audit, [({"u": "user", "a": "assistant"}.get(r, r), t) for r, t in out]


def conversations():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "ulysses", None]
    said = ["Yes.", "No?", "cut", "", " \t", "Well!\n", "end. \n", None, "a.b"]
    rows = []
    for conv in range(120):
        for _ in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 4, 5, 9]), rng.choice(roles), rng.choice(said)))
    rows += [(None, 1, "user", "Null id."), (None, 2, "assistant", "Yes."), (500, None, "user", "x"), (500, None, "user", "x")]
    return rows + [(900, t, "user" if t % 3 else "assistant", f"turn {t}." if t % 7 else "again.") for t in range(90)]


def expected(rows):
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, turns = faults_of(own), [t for t, _, _ in own if t is not None]
        cost, audit, edited = cheapest(tuple(own), tuple(faults))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in edited).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


@pytest.mark.parametrize("bits", [14, 1])
def test_repair_is_the_cheapest_that_plain_search_finds(spark, monkeypatch, bits):
    """bits: with 2^1 rows a segment, conversations cross many."""
    monkeypatch.setattr(conversation_repair, "SEGMENT_BITS", bits)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("conv", F.lit("clash")).withColumn("pos", F.lit("clash")).repartition(5)
    report, edited = conversation_repair.repair(df)
    digests = {r.conv_id: r.repaired_sha256 for r in conversation_repair.digests(edited).collect()}
    found = {r.conv_id: tuple(r)[1:] + (digests.get(r.conv_id, hashlib.sha256().hexdigest()),) for r in report.collect()}
    assert found == expected(rows)


def test_repair_reads_whole_results(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, edited = conversation_repair.repair(none)
    assert report.count() == 0 and edited.count() == 0 and conversation_repair.digests(edited).count() == 0


def test_damage_is_that_of_the_checksum(spark):
    import zlib

    rows = [(c, t, r, x) for c in (1, None) for t in [*range(40), None] for r, x in [("user", "Hi. You!"), (None, None)]]
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        one = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
        want += [one] * (0 if kind == 0 else 2 if kind == 3 else 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, map(tuple, queries.damaged(df).collect()))) == sorted(map(str, want))
