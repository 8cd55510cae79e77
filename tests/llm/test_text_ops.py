"""Operators on texts against brute force, with odd rows: nulls, empty and long texts, repeats, extra columns."""

import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import decontaminate, line_dedup, near_dup, packing, quality, registry, substring_dedup, token_store
from tests.compare import same

from . import brute

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h long, key string"


def odd_docs():
    r = random.Random(5)
    vocabulary = ["der", "Ébène", "zu", "onth", "x1", "Ñ", "the", "of", "Lorem", "ipsum", "dolor", "sit", "amet."] + [f"w{k}" for k in range(400)]
    base = [" ".join(r.choices(vocabulary, k=120)) for _ in range(6)]
    docs = []
    for k in range(70):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 6, 15])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        docs.append(" ".join(w))
    line = "a very common line that stands in many of the documents here"
    docs += [line + "\n" + " ".join(r.choices(vocabulary, k=30)) for _ in range(20)]
    docs += [docs[3]] * 12 + [None, "", " ", "one", "one", "Two words", "two  words", "\n\n", "a" * 400, "a" * 250, "ab" * 200, "é" * 120, "x\t y\r\n z"]
    docs += [" ".join(r.choices(vocabulary, k=n)) for n in (3, 4, 5, 6, 7, 8, 12, 15, 16, 17)] * 2
    docs.append(" ".join(r.choices(vocabulary, k=20_000)))
    return [(k * 3, t) for k, t in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 2, "k") for i, t in odd_docs()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(spark, docs, none):
    want = brute.substring_dedup(odd_docs())
    got = substring_dedup.dedup_substrings(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == want
    assert got[0].key == "k" and substring_dedup.dedup_substrings(none).count() == 0
    again = docs.unionByName(docs.where("doc_id = 9")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert substring_dedup.dedup_substrings(again).count() == docs.count() + 2


def test_substring_dedup_of_hot_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    want = brute.substring_dedup(odd_docs())
    got = substring_dedup.dedup_substrings(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == {k: v[:3] for k, v in want.items()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, none, size):
    want = brute.near_duplicates(odd_docs(), size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, size).collect()}
    assert got == want
    assert near_dup.near_duplicates(none, size).count() == 0


def test_near_duplicates_over_blocks(docs, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    want = brute.near_duplicates(odd_docs(), 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, 2).collect()} == want


def rows_dealt(monkeypatch, frame):
    """Counts the rows that are dealt to pairs of blocks from now on."""
    dealt, own = [], frame.sortWithinPartitions

    def counted(self, *columns):
        dealt.append(self.count())
        return own(self, *columns)

    monkeypatch.setattr(frame, "sortWithinPartitions", counted)
    return dealt


def test_near_duplicates_of_a_common_passage(spark, docs, monkeypatch):
    """A passage that many short texts share ties them to one cluster, whose blocks must not all meet."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    r = random.Random(6)
    passage, texts = " ".join(f"p{k}" for k in range(14)), []
    for _ in range(90):
        w = r.choices([f"v{k}" for k in range(900)], k=r.randrange(8, 16))
        texts.append(passage + " " + " ".join(w))
        if r.random() < 0.5:
            texts.append(passage + " " + " ".join([*w[:-1], "last"]))
    rows = list(enumerate(texts, 7))
    dealt = rows_dealt(monkeypatch, type(docs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute.near_duplicates(rows, 2)
    assert 0 < sum(dealt) < 3 * len(rows), dealt


@pytest.mark.parametrize("edits", [6, 9])
def test_near_duplicates_in_a_large_group(spark, docs, monkeypatch, edits):
    """Of many near copies of one text those that it joins don't meet one another; with nine edits it joins only some."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    r = random.Random(7)
    whole, rows = [f"v{k}" for k in range(150)], []
    for k in range(160):
        w = list(whole)
        for _ in range(edits if k else 0):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(k % 160, " ".join(r.choices(whole, k=60))) for k in range(155, 165)]  # ids that stand twice have nothing near
    dealt = rows_dealt(monkeypatch, type(docs))
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    want = brute.near_duplicates(rows[:160], 2)
    assert {i: got[i, n] for i, (n, _) in want.items()} == {i: c for i, (_, c) in want.items()}
    assert 0 < sum(dealt) < (160 * 4 if edits == 6 else 160 * 160), dealt


def test_near_duplicates_without_id(spark, docs):
    rows = near_dup.near_duplicates(docs.withColumn("doc_id", F.when(F.col("doc_id") > 30, F.col("doc_id"))), 2).collect()
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None) and len(rows) == len(odd_docs())


def items():
    d = dict(odd_docs())
    texts = [" ".join(d[3].split()[10:40]), "one", "", None, " ".join(d[9].split()[:9]), "never ever " * 8, d[0], d[0], "a very COMMON line that stands, in many of the documents here"]
    return list(enumerate(texts)) + [(10, "zu zu zu")]


def test_contamination(spark, docs, none):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == brute.contamination(odd_docs(), items())
    assert decontaminate.contamination(none, bench).count() == 0
    clean = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(clean) == len(odd_docs()) and not any(r.contaminated for r in clean)


def test_an_index_answers_any_benchmark(spark, docs):
    """Built once; other items, other widths, and lists in many blocks."""
    index = decontaminate.build_index(docs, block_bytes=2000)
    assert index.documents.select("block").distinct().count() > 5
    texts = dict(odd_docs())
    other = [(k, " ".join((texts[i] or "").split()[a : a + n])) for k, (i, a, n) in enumerate([(3, 0, 60), (6, 5, 3), (9, 2, 1), (12, 30, 12), (300, 0, 9)])]
    for rows, width in ((items(), 10), (other, 10), (other, 4), (items(), 1)):
        bench = spark.createDataFrame(rows, "item_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench, width, index=index).collect()}
        assert got == brute.contamination(odd_docs(), rows, width)


def test_contamination_of_odd_rows(spark):
    """Null and repeated doc_ids, repeated rows and null item_ids: each row is judged by itself."""
    phrase = "one two three four"
    docs = spark.createDataFrame([(None, phrase), (None, phrase), (1, phrase), (1, "nothing here"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, phrase), (5, phrase), (5, phrase), (6, "two three")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect())
    assert got == [("1", 0, []), ("1", 4, ["5", "6"]), ("2", 0, []), ("None", 4, ["5", "6"]), ("None", 4, ["5", "6"])]


def lines_left(docs, cut):
    """{doc_id: text} by one pass in order; ``cut`` gives a text's units."""
    seen, out = set(), {}
    for i, text in docs:
        kept = []
        for part in cut(text) if text is not None else ():
            normal = " ".join(part.translate(brute.LOWER).split(" "))
            normal = re.sub(r"[ \t\r\n\f\v]+", " ", normal).strip(" ")
            gone = normal != "" and normal in seen
            seen.add(normal)
            kept += [] if gone else [part]
        out[i] = None if text is None else "".join(kept)
    return out


PIECES = re.compile(r"\n|(?:(?<=[.!?,;:\n])|(?<![\s\S])|(?<=[ \t]))[^.!?,;:\n]{29,}[.!?,;:][ \t]++(?=[^\n]{30})")


def pieces(text):
    at, out = 0, []
    for m in PIECES.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


def test_lines(docs, none):
    r = random.Random(3)
    passage = "; ".join(" ".join(f"p{r.randrange(300)}" for _ in range(12)) for _ in range(6))
    extra = [(1000 + k, " ".join(f"w{r.randrange(400)}" for _ in range(40)) + ". " + passage + ". " + " ".join(f"v{r.randrange(400)}" for _ in range(40)) + ", end.") for k in range(5)]
    rows = odd_docs() + extra
    both = docs.unionByName(docs.sparkSession.createDataFrame([(i, t, "en", "s", 1, 2, "k") for i, t in extra], SCHEMA))
    for unit, cut in (("piece", pieces), ("line", lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)), ("paragraph", lambda t: re.split(r"(?<=\n)(?=[^\n])", t))):
        found = line_dedup.dedup_units(both, unit=unit).collect()
        got = {r.doc_id: r.text for r in found}
        if unit != "paragraph":
            assert got == lines_left(rows, cut)
        assert all(r._h == 2 and r.key == "k" for r in found) and len(found) == len(rows)
        assert line_dedup.dedup_units(none, unit=unit).count() == 0
    cut = {r.doc_id: r.spans for r in line_dedup.dedup_units(both).collect()}
    for i, text in extra[1:]:  # all of the passage but its first and last piece
        at = text.index(passage)
        gone = sum(min(s.end, at + len(passage)) - max(s.start, at) for s in cut[i] if s.end > at and s.start < at + len(passage))
        assert gone > 0.6 * len(passage)


def test_paragraphs(spark):
    rows = [(2, "One two\n\nThree\nfour\n \n\nFive"), (1, "three  four\n\nsix"), (3, "five\n\n\n"), (None, "SIX"), (None, "SIX"), (3, "Five")]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), "paragraph").collect())
    assert got[:3] == [("1", "three  four\n\nsix"), ("2", "One two\n\nFive"), ("3", got[2][1])] and got[4:] == [("None", ""), ("None", "")]
    assert sorted(t for i, t in got[2:4]) == ["", ""]


CLASHES = ["_h", "_d", "_x", "_c", "_s", "_o", "y", "spans", "gone", "row", "h", "d", "x", "kept", "n_removed", "_kept", "_n_removed", "score", "_score", "codes", "key", "rep", "cluster", "keys", "text_hash"]


def with_clashes(docs):
    return docs.select("doc_id", "text", *(F.lit(f"own {c}").alias(c) for c in CLASHES))


def test_clashing_columns(docs):
    odd = with_clashes(docs)
    plain = {r.doc_id: r for r in line_dedup.dedup_units(docs.select("doc_id", "text")).collect()}
    for r in line_dedup.dedup_units(odd).collect():
        assert all(r[c] == f"own {c}" for c in CLASHES) and (r.text, r["spans_"]) == (plain[r.doc_id].text, plain[r.doc_id].spans)
    kept, *_ = substring_dedup.added(odd.columns)
    plain = {r.doc_id: r.kept for r in substring_dedup.dedup_substrings(docs.select("doc_id", "text")).collect()}
    for r in substring_dedup.dedup_substrings(odd).collect():
        assert all(r[c] == f"own {c}" for c in CLASHES) and r[kept] == plain[r.doc_id]


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return public_tokenizers.path(name), lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_token_store(spark, docs, none, tmp_path):
    path, encode = tokenizer("word_bpe_49k.json")
    files = token_store.write_store(docs, path, f"file://{tmp_path}/a", file_tokens=3000)
    got = {r.doc_id: (r.start, r.n_tokens, bytes(r.tokens_le)) for r in token_store.read_store(files, buffer=500).collect()}
    at, every = 0, []
    for i, text in sorted(odd_docs()):
        ids = [*encode(text), 2]
        assert got[i] == (at, len(ids), np.array(ids, "<u4").tobytes()), i
        at += len(ids)
        every += ids
    assert files.count() > 1
    assert [token_store.token(files, p) for p in (0, 4000, at - 1)] == [every[0], every[4000], every[-1]]
    empty = token_store.write_store(none, path, f"file://{tmp_path}/b")
    assert token_store.read_store(empty).count() == 0


def test_dac_codes():
    ids = np.array([0, 255, 256, 65535, 65536, 2**32 - 1, 7] * 400, np.uint32)
    dac = token_store.DacFile(token_store.dac_encode(ids, np.array([5]), np.array([len(ids)])))
    assert (dac.document(0) == ids).all() and dac.get([5])[0] == 2**32 - 1


class Counted(io.BytesIO):
    """A file that counts the bytes read."""

    count = 0

    def read(self, size=-1):
        got = super().read(size)
        self.count += len(got)
        return got


def test_dac_ranges():
    r = np.random.default_rng(2)
    ids = np.where(r.random(100_000) < 0.7, r.integers(0, 200, 100_000), r.integers(0, 2**20, 100_000)).astype(np.uint32)
    ends = np.unique(np.append(r.integers(1, len(ids), 300), len(ids)))
    data = token_store.dac_encode(ids, np.arange(len(ends)), ends)
    file = Counted(data)
    reader = token_store.DacReader(file)
    for k in (0, 1, 57, len(ends) - 1):
        assert (reader.document(k) == ids[ends[k - 1] if k else 0 : ends[k]]).all()
    for a, b in ((0, 0), (0, 1), (511, 514), (99_000, 100_000), (0, 100_000)):
        assert (reader.ids(a, b) == ids[a:b]).all()
    file.count = 0
    assert [int(reader.ids(p, p + 1)[0]) for p in (5, 4096, 77_777)] == [int(ids[p]) for p in (5, 4096, 77_777)] and file.count < 1000
    with pytest.raises(IndexError):
        reader.ids(0, 100_001)


def test_token_store_of_odd_rows(spark, tmp_path):
    """Repeated doc_ids are rows of their own in order, null ones come last."""
    path, encode = tokenizer("word_bpe_49k.json")
    df = spark.createDataFrame([(2, "b b", 1), (None, "none", 1), (1, None, 1), (2, "b b", 1), (None, None, 1)], "doc_id long, text string, start int")
    got = token_store.read_store(token_store.write_store(df, path, f"file://{tmp_path}/odd")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 2, 2, None, None] and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert got[0].n_tokens == 1 and got[1].n_tokens == len(encode("b b")) + 1 and sorted(r.n_tokens for r in got[3:]) == [1, len(encode("none")) + 1]


def check_packing(rows, lengths, capacity):
    """Every piece once, gapless sequences within capacity."""
    by, seen = {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for i, n in lengths.items():
        at = 0
        for piece, (k, start, length) in enumerate(sorted(seen[i])):
            assert (k, start) == (piece, at) and (length == capacity or piece == 0)
            at += length
        assert at == n
    return len(by), -(-sum(lengths.values()) // capacity)


def test_packing(spark, docs, none):
    path, encode = tokenizer("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path, capacity=300).collect()
    ids = {i: [*encode(t), 0] for i, t in odd_docs()}
    used, bound = check_packing(rows, {i: len(x) for i, x in ids.items()}, 300)
    rooms: list[int] = []
    for n in sorted((r.length for r in rows), reverse=True):  # first fit decreasing
        k = next((k for k, room in enumerate(rooms) if room >= n), None)
        if k is None:
            rooms.append(300 - n)
        else:
            rooms[k] -= n
    assert bound <= used <= len(rooms)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack_documents(none, path).count() == 0
    placed = packing.pack_documents(docs, path, capacity=300)
    whole = {r.sequence_id: r for r in packing.sequences(docs, placed, path, capacity=300).collect()}
    assert len(whole) == used and all(len(r.ids) == 4 * r.n_tokens for r in whole.values())


def exact(lengths, capacity):
    """Fewest sequences by trying all."""
    best = [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[k] and rooms[j] not in rooms[:j]:
                go(k + 1, rooms[:j] + [rooms[j] - lengths[k]] + rooms[j + 1 :])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best[0]


def test_plans_are_whole_and_reduction_keeps_the_optimum():
    r = random.Random(2)
    for _ in range(150):
        lengths = sorted((r.randint(3, 20) for _ in range(9)), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        patterns = packing.plan(counts, 20)
        got = {}
        for times, pieces in patterns:
            assert sum(a * b for a, b in pieces) <= 20
            for a, b in pieces:
                got[a] = got.get(a, 0) + times * b
        assert got == counts
        h = packing.Histogram(dict(counts))
        fixed = 0
        for j in sorted(h.n, reverse=True):
            while j in h.n and (p := packing.dominating(h, j, 20)) is not None:
                for x in (j, *p):
                    h.take(x, 1)
                fixed += 1
        rest = sorted((x for x, n in h.n.items() for _ in range(n)), reverse=True)
        assert fixed + exact(rest, 20) == exact(lengths, 20)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = registry.queries()["op8_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.98
    w = quality.train_on(docs, labels.limit(0))
    odd = quality.scored(spark.createDataFrame([(1, None, "a"), (None, "", "b")], "doc_id long, text string, score2 string"), w, keep=("score2",)).collect()
    assert [r.score for r in odd] == [0.5, 0.5] and {r.score2 for r in odd} == {"a", "b"}


def quality_by_hand(train, texts, bits):
    """Scores from dictionaries: hashed words, pairs and their shapes, one weight at a time."""
    mix, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def grams(text):
        words, out = [quality.word_hashes(w) for w in (text or "").split()], {}
        for k, own in enumerate(words):
            for side in (0, 1):
                after = own[side] + 7 if k + 1 == len(words) else own[side] * 1_000_003 + words[k + 1][side] + 1
                for h in (own[side], after):
                    f = (h * mix & mask) >> (64 - bits)
                    out[f] = out.get(f, 0) + 1
        n = sum(out.values())
        return {f: c / n for f, c in out.items()}

    z, n, alpha, l1, l2 = {}, {}, 2.0, 1e-4, 1e-4

    def weight(f):
        v = z.get(f, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((1 + math.sqrt(n.get(f, 0.0))) / alpha + l2)

    ones = max(1, sum(y for _, y in train))
    balance = {1: len(train) / 2 / ones, 0: len(train) / 2 / max(1, len(train) - ones)}
    for _ in range(3):
        for text, y in train:
            x = grams(text) | {"bias": 1.0}
            w = {f: weight(f) for f in x}
            p = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - y) * v * balance[y]
                s = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / alpha
                z[f], n[f] = z.get(f, 0.0) + g - s * w[f], n.get(f, 0.0) + g * g
    return [1 / (1 + math.exp(-weight("bias") - sum(weight(f) * v for f, v in grams(t).items()))) for t in texts]


def test_quality_against_dictionaries(spark, docs):
    bits = 12
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in odd_docs()] + [(None, 1), (3, None)], "doc_id long, y int")
    order = [r.doc_id for r in labels.where("doc_id is not null and y is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    texts = dict(odd_docs())
    train = [(texts[i], int(i % 4 == 0)) for i in order]
    w = quality.train(docs, labels, bits=bits)
    got = {r.doc_id: r.score for r in quality.scored(docs, w, bits).collect()}
    want = quality_by_hand(train, texts.values(), bits)
    assert all(abs(got[i] - s) < 1e-4 for i, s in zip(texts, want, strict=True)) and len(got) == len(texts)
    long = "A" * 30 + "b" * 30
    assert quality.word_hashes(long)[1] == quality.word_hashes("Zy")[1] and quality.word_hashes("a-" * 40)[1] != quality.word_hashes("a-" * 20)[1]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], DATA)


