"""Proximity matches of operator 7, which its SQL doesn't have."""

import math
import random

import xxhash

from engram.llm import decontaminate, registry

DATA = "/root/testdata/sf0.001"
WORDS = "a b c d e f g h i j".split()


def proximity_docs():
    """Copies of the passage with none to four words changed, by words known and not known elsewhere, and random texts."""
    r = random.Random(3)
    docs = [list(WORDS), WORDS[:-1] + ["new"], ["new"] + WORDS[1:], ["x", *WORDS[:4], "y", *WORDS[4:9]], WORDS[:5] + ["y"] * 3 + WORDS[8:], WORDS[::-1], [], ["a"]]
    for k in range(60):
        docs.append(r.choices([*WORDS, "x", "y", "z"], k=r.randint(5, 40)))
    return [(k, " ".join(d)) for k, d in enumerate(docs)]


def near_by_hand(words, window, entered, share=0.8):
    need, out = math.ceil(share * len(set(window)) - 1e-9), set()
    for p, w in enumerate(words):
        around = words[max(0, p - 9) : p + 10]
        phrase = any(p >= at and words[p - at : p - at + len(window)] == window for at, t in enumerate(window) if t == w)
        if w in entered and len(set(window) & set(around)) >= need and not phrase:
            out.add(p)
    return out


def test_proximity_finds_changed_passages(spark):
    """The passage's rarest word, one that no document has, is among those that copies lack."""
    docs = spark.createDataFrame([(1, "a b c d e f g h x y"), (2, "a b c d e f g h j y"), (3, "a b c d e f g x y z"), (4, "i")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(WORDS))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, share=0.8).collect()}
    assert {k for k, r in got.items() if r.n_near} == {1, 2} and got[1].near_items == ["7"]
    unknown = decontaminate.contamination(docs.where("doc_id = 1"), bench, share=0.8).collect()
    assert unknown[0].n_near > 0 and not unknown[0].contaminated


def test_proximity_against_brute_force(spark):
    rows = proximity_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(WORDS)), (8, "a b a c"), (9, "a unheard b c d e f g h i")], "item_id long, text string")
    index = decontaminate.build_index(docs, block_bytes=300)  # several blocks
    ranked = decontaminate.ranked_windows(decontaminate.windows_of(bench), index)
    item_of = {r.w: r["items"][0] for r in ranked.collect()}
    entries = {}
    for r in ranked.select("w", decontaminate.entered(0.8).alias("e")).collect():
        entries[(item_of[r.w],)] = {e["term"] for e in r.e}
    texts_of = [(r.block, r.first, r.n_words, r.doc_id) for r in index.documents.collect()]
    got = {}
    for r in decontaminate.proximity_matches(index, ranked, decontaminate.phrase_matches(index, ranked)).collect():
        ((first, doc),) = [(f, d) for b, f, n, d in texts_of if b == r.block and f <= r.place < f + n]
        got.setdefault((item_of[r.w], doc), set()).add(r.place - first)
    term = lambda w: xxhash.xxh64_intdigest(w) - (1 << 64 if xxhash.xxh64_intdigest(w) >> 63 else 0)
    for item, window in ((7, WORDS), (8, "a b a c".split()), (9, "a unheard b c d e f g h i".split())):
        entered = {w for w in window if term(w) in entries.get((item,), set())}
        for k, text in rows:
            words = text.split()
            assert got.get((item, k), set()) == near_by_hand(words, window, entered), (item, text)
            # no stretch of ten words with enough of the terms is without a match or the phrase
            need = math.ceil(0.8 * len(set(window)) - 1e-9)
            for s in range(len(words)):
                part = words[s : s + 10]
                if len(set(part) & set(window)) >= need:
                    phrase = any(words[b : b + len(window)] == window for b in range(max(0, s - 9), s + 10))
                    assert phrase or any(s <= p < s + 10 for p in got.get((item, k), ())), (item, text)


def test_proximity_query_keeps_the_phrases(spark):
    plain = registry.queries()["op7_decontamination"](spark, DATA)
    near = registry.queries()["op7_proximity"](spark, DATA)
    assert sorted(map(tuple, near.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
