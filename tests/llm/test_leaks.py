"""Benchmark decontamination: long runs, short items, repeated ones, and the choice of occurrences against plain loops."""

import random
from collections import Counter, defaultdict

import pytest

from meterfold.llm import decontamination
from meterfold.llm.decontamination import Params


def table(spark, name, texts):
    return spark.createDataFrame(list(enumerate(texts)), f"{name} long, text string")


def pairs(spark, docs, items):
    return {(r.doc_id, r.item_id): r for r in decontamination.leaks(table(spark, "doc_id", docs), table(spark, "item_id", items)).collect()}


def test_runs_of_any_length(spark):
    """Joined numbers and words of hundreds of kilobytes are single tokens, and what stands beside them is found."""
    item = "How many apples does the old farmer keep in the barn of his brother?"
    docs = ["1" + ".1" * 100_000, "a" + "'a" * 100_000, "1" + ",22" * 100_000 + " " + item, "x " * 100_000 + item, "e\u0301" * 100_000, "1 + " * 50_000]
    assert set(pairs(spark, docs, [item, "1" + ".1" * 5000])) == {(2, 0), (3, 0)}


SHORT = ["What is 12 + 7?", "Compute 3 times 4.", "Wie viel ist 6 mal 9?", "¿Cuánto es 8 por 5?", "Combien font 9 fois 7 ?", "Convert 5 kg into g"]


def test_short_items_are_found_with_other_numbers(spark):
    docs = ["What is 15 + 9?", "Then: Compute 8 times 9. And so on.", "Frage: Wie viel ist 16 mal 4?", "Hola. ¿Cuánto es 18 por 2? Bien.", "Combien font 2 fois 3 ?", "Convert 7 miles into feet", "Convert 7 miles onto feet"]
    assert set(pairs(spark, docs, SHORT)) >= {(k, k) for k in range(6)}
    assert {d for d, _ in pairs(spark, docs, SHORT)} <= set(range(7))


def test_short_items_need_their_words_and_operators(spark):
    docs = ["What is 15 - 9?", "What was 15 + 9?", "Compute 8 plus 9.", "It is 15 + 9", "15 + 9", "3 times", "Chapter 3 of 4.", "12 7 3 4 6 9", "What is it?", "Multiply 3 times 4"]
    assert pairs(spark, docs, SHORT) == {}


def test_short_items_need_values_that_map_as_one(spark):
    items = ["What is 12 + 12?", "What is 31 / 44?"]
    docs = ["What is 9 + 9?", "What is 9 + 8?", "What is 9 + 8? What is 7 + 7?", "What is 44 / 31?", "What is 31 / 45?"]
    assert set(pairs(spark, docs, items)) == {(0, 0), (2, 0), (4, 1)}


def test_short_items_precision_and_recall(spark):
    """Ten other versions of each short item are found; sentences about numbers in four languages are left alone."""
    rng = random.Random(2)
    other = lambda t: "".join(str(rng.randint(1, 99)) if w.isdigit() else w for w in __import__("re").split(r"(\d+)", t))
    asked = [other(t) for t in SHORT[:5] for _ in range(10)]
    words = {"en": "the price was about {} in {} and then {} more came by", "de": "der Preis war etwa {} im Jahr {} und dann kamen {} dazu", "es": "el precio era {} en {} y luego {} m\u00e1s", "fr": "le prix \u00e9tait de {} en {} puis {} de plus"}
    plain = [t.format(*rng.sample(range(1, 99), 3)) for t in words.values() for _ in range(50)]
    found = pairs(spark, asked + plain, SHORT)
    assert sum((d, d // 10) in found for d in range(50)) >= 48
    assert all(d < 50 and i == d // 10 for d, i in found)


def test_a_single_token_is_held_by_itself_only(spark):
    docs = ["Yes", "yes.", "Yes, that is so", "42", "It is 42.", "No"]
    assert set(pairs(spark, docs, ["Yes", "42", "漢"])) == {(0, 0), (1, 0), (3, 1)}


def test_repeated_items_and_documents(spark):
    item = "How many apples does the old farmer keep in the barn of his brother?"
    found = pairs(spark, [item, item, "nothing"], [item, item, item])
    assert set(found) == {(d, i) for d in (0, 1) for i in (0, 1, 2)} and all(r.verbatim for r in found.values())


def plain_occurrences(hits, p):
    """Like the operator's rules, for one pair of document and item: the best of all buckets of shifts."""
    n_windows, wide = hits[0]["n_windows"], hits[0]["n_windows"] + hits[0]["width"] - 1
    shifts = [h["at"] - h["item_at"] for h in hits]
    if len({h["item_at"] for h in hits}) < p.coverage * n_windows:
        return None
    best = None
    for grid in (0, 1) if min(shifts) != max(shifts) else (0,):
        buckets = defaultdict(list)
        for h, s in zip(hits, shifts, strict=True):
            buckets[(s + grid * (wide // 2)) // wide].append((s, h))
        for own in buckets.values():
            support = Counter(s for s, _ in own)
            chosen = {}
            for s, h in own:
                if h["item_at"] not in chosen or (support[s], -s) > chosen[h["item_at"]][0]:
                    chosen[h["item_at"]] = ((support[s], -s), h)
            if len(chosen) < p.coverage * n_windows:
                continue
            values = defaultdict(set)
            for _, h in chosen.values():
                for was, now in zip(h["item_slots"], h["slots"], strict=True):
                    values[was].add(now)
            crossed = lambda w, v: own[0][1]["typed"] and v != {w} and v <= set(values)
            consistent = [w for w, v in values.items() if len(v) == 1 and not crossed(w, v)]
            if len(consistent) < p.consistent * len(values):
                continue
            changed = sum(values[w] != {w} for w in consistent)
            verbatim = changed == 0 and len(consistent) == len(values)
            rank = (verbatim, len(chosen), len(consistent), n_windows, len(values), changed)
            best = rank if best is None or rank > best else best
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_occurrences_are_those_of_plain_loops(spark, seed):
    rng, p, rows = random.Random(seed), Params(), []
    for doc in range(60):
        n_windows, width = rng.choice([(1, 5), (3, 8), (6, 8)])
        slots = {at: [f"v{rng.randint(0, 3)}" for _ in range(rng.randint(0, 3))] for at in range(n_windows)}
        for start in rng.sample(range(0, 60), rng.randint(1, 3)):
            changes = {f"v{k}": rng.choice([f"v{k}", f"x{k}", f"x{k}", f"v{3 - k}"]) for k in range(4)}
            for at in range(n_windows):
                if rng.random() < 0.85:
                    now = [changes[w] if rng.random() < 0.9 else "odd" for w in slots[at]]
                    rows.append(dict(doc=doc, item=doc % 7, at=start + at + rng.choice([0, 0, 0, 1]), slots=now, item_at=at, item_slots=slots[at], n_windows=n_windows, width=width, typed=n_windows == 1))
    schema = "doc long, item long, at long, slots array<string>, item_at long, item_slots array<string>, n_windows long, width int, typed boolean"
    unique = list({(r["doc"], r["at"], r["item_at"]): r for r in rows}.values())
    found = {r.doc: (r.verbatim, r.matched, r.n_consistent, r.n_windows, r.n_slots, r.n_changed) for r in decontamination.occurrences(spark.createDataFrame(unique, schema), p).collect()}
    groups = defaultdict(list)
    for r in unique:
        groups[r["doc"]].append(r)
    want = {d: best for d, own in groups.items() if (best := plain_occurrences(own, p))}
    assert found == want and 5 < len(want) < 60
