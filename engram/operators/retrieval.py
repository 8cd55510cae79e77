"""Hybrid retrieval: BM25, vectors, metadata, bounded graph expansion, fusion and ranks.

Queries and documents are tables; each channel is an equi-join and an aggregate
for all queries at once, ranked by a window that Spark limits before its shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from engram.functions import text
from engram.session import checkpointed, small_side

RECALL_K, CANDIDATES, DEPTH, DECAY, K1, B = 20, 40, 1, 0.8, 1.5, 0.75
#: Rows of a block of queries and of a block of vectors.
QUERY_ROWS, VECTOR_ROWS = 512, 4096


def _texts(docs: DataFrame) -> DataFrame:
    """id and terms of ``docs`` (id, content and, if there are any, tags, which count as words of the text)."""
    whole = text.document_text(F.col("content"), F.col("tags")) if "tags" in docs.columns else F.col("content")
    return docs.select("id", text.tokens(whole).alias("terms"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """id, term, tf from ``docs`` (id, content, tags)."""
    return _texts(docs).select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


#: Rows (query, term) of a pass over the documents, and cells of a table of documents by queries.
ASKED_ROWS, CELLS = 1 << 20, 1 << 21


class _Best:
    """The ``k`` best of the rows added for each query, by score descending, then id.  Rows that can't be are dropped now and then."""

    ROWS = 1 << 18

    def __init__(self, n_queries: int, k: int):
        self.k, self.least, self.held, self.new = k, np.full(n_queries, -np.inf), [], 0

    def add(self, query: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        kept = np.flatnonzero(score >= self.least[query])
        if len(kept):
            self.held.append(pa.table({"query": query[kept], "id": ids.take(pa.array(kept)), "score": score[kept]}))
            self.new += len(kept)
        if self.new > self.ROWS:
            self.rows()

    def rows(self) -> pa.Table | None:
        if self.held:
            t = pa.concat_tables(self.held)
            t = t.take(pc.sort_indices(t, sort_keys=[("query", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start")).combine_chunks()
            query = t["query"].to_numpy()
            place = np.arange(len(query)) - np.searchsorted(query, query)
            last = place == self.k - 1
            self.least[query[last]] = t["score"].to_numpy()[last]
            self.held, self.new = [t.filter(pa.array(place < self.k))], 0
        return self.held[0] if self.held else None


def bm25(queries: DataFrame, docs: DataFrame, k1: float = K1, b: float = B, k: int | None = None) -> DataFrame:
    """query_id, id, score (rounded to 6 places) of each document with a term of the query, in its content or its tags.

    With ``k`` only rows that can be among a query's k best (by score, then id).  Documents are tokenised once into a row of
    counts of the queries' terms, which is written; scores are added up within tasks, where each keeps k rows a query, so
    nothing that grows as documents times queries is moved.  Queries are dealt to passes of about ``ASKED_ROWS`` terms in all,
    which bounds what is broadcast.  Rows of one id count as one text, of which the longest gives the length.
    """
    wanted = checkpointed(queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term")).distinct())
    passes, out = -(-wanted.count() // ASKED_ROWS) or 1, None
    for n in range(passes):
        scored = _bm25_pass(wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n), docs, k1, b, k)
        out = scored if out is None else out.unionByName(scored)
    return out


def _bm25_pass(wanted: DataFrame, docs: DataFrame, k1: float, b: float, k: int | None) -> DataFrame:
    """``bm25`` for queries (query_id, term) that one broadcast holds."""
    context = docs.sparkSession.sparkContext
    pairs = wanted.toArrow()
    term, query = (pairs[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("term", "query_id"))
    number, who = term.indices.to_numpy(), query.indices.to_numpy()
    order = np.lexsort((who, number))
    names, asked, bounds = term.dictionary, who[order], np.searchsorted(number[order], np.arange(len(term.dictionary) + 1))
    known = context.broadcast(names)
    kind = StructType().add("id", docs.schema["id"].dataType).add("len", "long").add("terms", ArrayType(IntegerType())).add("tf", ArrayType(LongType()))
    schema = to_arrow_schema(kind)

    def count(batches):
        for batch in batches:
            lists = batch["terms"]
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=known.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row, wide = np.repeat(np.arange(len(length)), length), len(known.value) or 1
            cells, tf = np.unique((row * wide + at)[at >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(cells // wide, np.arange(len(length) + 1)), pa.int32())
            columns = [batch["id"], pa.array(length), pa.ListArray.from_arrays(offsets, pa.array(cells % wide, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    counts = checkpointed(_texts(docs).mapInArrow(count, kind))
    n, avg_len = counts.agg(F.count("*"), F.avg("len")).first()
    again = counts.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    if not again.isEmpty():
        again = checkpointed(again)
        several = counts.join(again, counts["id"].eqNullSafe(again["id"]), "left_semi")
        lengths = several.groupBy("id").agg(F.max("len").alias("len"))
        each = several.select("id", F.explode(F.arrays_zip("terms", "tf")).alias("x")).groupBy("id", F.col("x.terms").alias("t")).agg(F.sum("x.tf").alias("tf"))
        each = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "tf"))).alias("x")).withColumnRenamed("id", "of")
        one = lengths.join(each, lengths["id"].eqNullSafe(each["of"])).select("id", "len", F.col("x.t").alias("terms"), F.col("x.tf").alias("tf"))
        counts = checkpointed(counts.join(again, counts["id"].eqNullSafe(again["id"]), "left_anti").unionByName(one))

    def frequencies(batches):
        found = np.zeros(len(known.value), np.int64)
        for batch in batches:
            found += np.bincount(batch["terms"].flatten().to_numpy(zero_copy_only=False), minlength=len(found))
        met = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(found[met])], names=["t", "df"])

    each = counts.select("terms").mapInArrow(frequencies, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()  # a row for each term of the queries
    df = np.zeros(len(names), np.int64)
    df[each["t"].to_numpy()] = each["df"].to_numpy()
    shared = context.broadcast((query.dictionary, asked, bounds, np.log(1 + (n - df + 0.5) / (df + 0.5))))
    scored = StructType().add("query_id", wanted.schema["query_id"].dataType).add("id", docs.schema["id"].dataType).add("score", "double")
    rows = to_arrow_schema(scored)

    def score(batches):
        ids_of, asked, bounds, idf = shared.value
        best = _Best(len(ids_of), k) if k is not None else None
        shown = lambda q, ids, s: pa.RecordBatch.from_arrays([ids_of.take(pa.array(q)), ids, pa.array(s)], schema=rows)
        step = max(1, CELLS // max(1, len(ids_of)))
        for whole in batches:
            for batch in (whole.slice(at, step) for at in range(0, len(whole), step)):
                t, tf = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tf"))
                doc = np.repeat(np.arange(len(batch)), pc.list_value_length(batch["terms"]).to_numpy(zero_copy_only=False))
                length = batch["len"].to_numpy(zero_copy_only=False)[doc]
                weight = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len)) if len(t) else np.zeros(0)
                wide = bounds[t + 1] - bounds[t]
                each = np.repeat(np.arange(len(t)), wide)
                place = np.arange(len(each)) - np.repeat(np.cumsum(wide) - wide, wide)
                cell = doc[each] * len(ids_of) + asked[bounds[t[each]] + place]
                found = np.bincount(cell, weight[each], len(batch) * len(ids_of))
                met = np.flatnonzero(found)
                d, q = met // len(ids_of), met % len(ids_of)
                marks = np.round(found[met], 6)
                if best is None:
                    yield shown(q, batch["id"].take(pa.array(d)), marks)
                elif len(met):
                    near = np.flatnonzero(marks >= best.least[q])
                    best.add(q[near], batch["id"].take(pa.array(d[near])), marks[near])
        kept = best.rows() if best is not None else None
        if kept is not None:
            yield from (shown(r["query"].to_numpy(), r["id"], r["score"].to_numpy()) for r in kept.to_batches(max_chunksize=1 << 16))

    return counts.mapInArrow(score, scored)


def top_k(scored: DataFrame, k: int, positive: bool = True, by: str = "query_id", score: str = "score") -> DataFrame:
    """The k best of each query by (score descending, id), ranked from 1; scores of zero and less are dropped after ranking."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), "id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.where(F.col(score) > 0) if positive else ranked


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def vector_scores(queries: DataFrame, vectors: DataFrame, k: int | None = None, others: bool = False) -> DataFrame:
    """query_id, id, score: every query vector against every row, or each query's ``k`` best in each block of rows.

    Queries (query_id, vector) are dealt to blocks of about ``QUERY_ROWS`` rows and ``vectors`` (id, vector) to blocks of
    about ``VECTOR_ROWS``, however many there are; each pair of blocks is one matrix product in a task of its own.
    With ``k``, what leaves it is at most k rows a query (ties by id), so the best k overall are among them.
    ``others`` leaves out a query's own id.  Vectors that are null, empty or not finite, and pairs of different lengths,
    have no score.
    """
    n_q, n_v = -(-queries.count() // QUERY_ROWS) or 1, -(-vectors.count() // VECTOR_ROWS) or 1
    deal = lambda key, n: F.pmod(F.xxhash64(key, "vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # columns of their own on either side: a cogroup of a table with itself mixes up shared ones
    q = queries.select(F.col("query_id").alias("asked"), F.col("vector").alias("a"), deal("query_id", n_q).alias("block")).withColumn("part", every(n_v))
    v = vectors.select(F.col("id").alias("row"), F.col("vector").alias("b"), deal("id", n_v).alias("part")).withColumn("block", every(n_q))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        of_q, of_v = _by_length(left["asked"], left["a"]), _by_length(right["row"], right["b"])
        parts = []
        for length in sorted(of_q.keys() & of_v.keys()):
            (q_ids, a), (ids, b) = of_q[length], of_v[length]
            found = _cosines(a, b)
            kept = np.ones(found.shape, bool)
            if others:
                kept = q_ids.to_numpy(zero_copy_only=False)[:, None] != ids.to_numpy(zero_copy_only=False)[None, :]
            if k is not None and k < len(ids):  # ids ascend, so a stable order breaks ties by id
                best = np.argsort(np.where(kept, -found, np.inf), axis=1, kind="stable")[:, :k]
                row, column = np.repeat(np.arange(len(a)), best.shape[1]), best.reshape(-1)
                real = kept[row, column]
                row, column = row[real], column[real]
            else:
                row, column = np.nonzero(kept)
            parts.append(pa.table([q_ids.take(pa.array(row)), ids.take(pa.array(column)), pa.array(found[row, column])], schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    kind = StructType().add("query_id", queries.schema["query_id"].dataType).add("id", vectors.schema["id"].dataType).add("score", "double")
    schema = to_arrow_schema(kind)
    return q.groupBy("block", "part").cogroup(v.groupBy("block", "part")).applyInArrow(score, kind)


def _by_length(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """For each length of vectors, their ids in order and the matrix of them in doubles."""
    order = pc.sort_indices(ids)
    ids, lists, out = ids.take(order).combine_chunks(), vectors.take(order).combine_chunks(), {}
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    for length in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == length)
        flat = pc.fill_null(lists.take(pa.array(rows)).flatten().cast(pa.float64()), np.nan)
        matrix = flat.to_numpy(zero_copy_only=False).reshape(len(rows), length)
        finite = np.isfinite(matrix).all(axis=1)
        out[int(length)] = ids.take(pa.array(rows[finite])), matrix[finite]
    return out


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounded to 6 places; 0 where a norm is 0."""
    norms = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
    return np.round(np.divide(a @ b.T, norms, out=np.zeros(norms.shape), where=norms != 0), 6) + 0.0


#: Words of an automaton; more make several, each a pass over the texts.
WORDS = 1 << 16
#: Up to FEW words of at most SHORT letters are looked up one by one.
SHORT, FEW = 3, 512


def said(words: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, id where a document's ``content`` holds a ``word`` of the query (both lower-cased already).

    Documents meet all words at once: an automaton of the words goes to every task, which reads each text through it and
    gives a row for each query that has a word there.  Queries are dealt to as many automata as keep each at about
    ``WORDS`` words, so what is broadcast is bounded.  An empty word is in every document.
    """
    return _met(words.select("query_id", "word", F.lit(False).alias("tag")), docs.select("id", "content", F.array().cast("array<string>").alias("tags")))


def _met(sought: DataFrame, docs: DataFrame, most: int | None = None) -> DataFrame:
    """``said`` for words and tags (query_id, word, tag): a tag is met where it is one of the document's ``tags``.  With ``most``
    only rows that can be among a query's first so many by id."""
    sought = checkpointed(sought.where("word is not null").distinct())
    blank = sought.where("word = '' and not tag").select("query_id").distinct()
    found = docs.select("id").crossJoin(blank).select("query_id", "id")  # what an empty word asks for
    every = blank.select(F.col("query_id").alias("of"))
    real = sought.join(every, F.col("query_id").eqNullSafe(F.col("of")), "left_anti")
    passes = -(-real.count() // WORDS)
    for k in range(passes):
        mine = real.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k)
        found = found.unionByName(_read_through(mine, docs, most))
    return found


def _read_through(words: DataFrame, docs: DataFrame, most: int | None = None) -> DataFrame:
    """``_met`` for words and tags that one automaton holds: a row once for each document and query."""
    held = words.toArrow()
    asked = held["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    named = {}
    for word, tag, q in zip(held["word"].to_pylist(), held["tag"].to_pylist(), asked.indices.to_pylist()):
        named.setdefault((tag, word), []).append(q)
    lists = {key: np.array(sorted(qs), np.int64) for key, qs in named.items()}
    shared = docs.sparkSession.sparkContext.broadcast((asked.dictionary, lists))
    kind = StructType().add("query_id", words.schema["query_id"].dataType).add("id", docs.schema["id"].dataType)
    schema = to_arrow_schema(kind)

    def read(batches):
        import ahocorasick

        (ids_of, lists), automaton = shared.value, ahocorasick.Automaton()
        names = [word for tag, word in lists if not tag and word]
        labels = {word: qs for (tag, word), qs in lists.items() if tag}
        if not lists:
            return
        short = [word for word in names if len(word) <= SHORT]  # they match all over a text: one look each
        short = short if len(short) <= FEW else []
        for word in names if not short else [w for w in names if len(w) > SHORT]:
            automaton.add_word(word, word)
        automaton.make_automaton()
        best = _Best(len(ids_of), most) if most is not None else None
        shown = lambda q, ids: pa.RecordBatch.from_arrays([ids_of.take(pa.array(q)), ids], schema=schema)
        for batch in batches:
            rows, whose, ids = [], [], batch["id"]
            for k, (content, tags) in enumerate(zip(batch["content"].to_pylist(), batch["tags"].to_pylist())):
                met = {w for _, w in automaton.iter(content)} if content and len(automaton) else set()
                met.update(w for w in short if content and w in content)
                of = [lists[False, w] for w in met]
                of += [labels[t] for t in set(tags or ()) if t in labels]
                if of:
                    mark = np.zeros(len(ids_of), bool)
                    mark[np.concatenate(of)] = True
                    whose.append(np.flatnonzero(mark))
                    rows.append(np.full(len(whose[-1]), k))
            if rows:
                q, at = np.concatenate(whose), np.concatenate(rows)
                if best is None:
                    yield shown(q, ids.take(pa.array(at)))
                else:
                    first = _Best(len(ids_of), most)
                    first.add(q, ids.take(pa.array(at)), np.ones(len(q)))
                    first = first.rows()
                    best.add(first["query"].to_numpy(), first["id"].combine_chunks(), first["score"].to_numpy())
        kept = best.rows() if best is not None else None
        if kept is not None:
            yield from (shown(r["query"].to_numpy(), r["id"]) for r in kept.to_batches(max_chunksize=1 << 16))

    return docs.select("id", "content", "tags").mapInArrow(read, kind)


def metadata_matches(queries: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """query_id, id, score 1.0 where a tag or a keyword of ``queries`` (query_id, keywords, tags) is met; with ``most`` the first
    so many of a query by id.  Tags and keywords are met in one reading, so rows are different as they come if ids are."""
    none = F.array().cast("array<string>")
    low = lambda c: F.transform(F.coalesce(c, none), F.lower)
    word = lambda c, tag: queries.select("query_id", F.explode(low(F.col(c))).alias("word"), F.lit(tag).alias("tag"))
    docs = nodes.select("id", F.lower("content").alias("content"), low(F.col("tags")).alias("tags"))
    several = not nodes.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()
    found = _met(word("keywords", False).unionByName(word("tags", True)), docs, None if several else most)
    found = (found.distinct() if several else found).withColumn("score", F.lit(1.0))
    return found if most is None else top_k(found, most).select("query_id", "id", "score")


def memberships(nodes: DataFrame) -> DataFrame:
    """group, id: what makes nodes (id, provenance) neighbours.  Each provenance id is a group of the nodes that name it, and
    a pair of its own for each of them where it is a node itself; the groups stand for all pairs in them."""
    each = nodes.select("id", F.explode(F.array_distinct("provenance")).alias("p")).where("p is not null")
    named = each.join(nodes.select(F.col("id").cast("string").alias("p")), "p", "left_semi").where(F.col("id").cast("string") != F.col("p"))
    pair = F.concat_ws(chr(1), F.lit("n"), "id", "p")
    kind = dict(nodes.dtypes)["id"]
    return each.select(F.concat_ws(chr(1), F.lit("p"), "p").alias("group"), "id").unionByName(named.select(pair.alias("group"), "id")).unionByName(named.select(pair.alias("group"), F.col("p").try_cast(kind).alias("id")))


def provenance_neighbours(nodes: DataFrame) -> DataFrame:
    """a, b: nodes (id, provenance) that share a provenance id or name one another; both ways.  As many rows as pairs:
    ``expand`` goes by ``memberships`` instead."""
    m = memberships(nodes)
    return m.withColumnRenamed("id", "a").join(m.withColumnRenamed("id", "b"), "group").where("a <> b").select("a", "b").distinct()


def expand(seeds: DataFrame, members: DataFrame, depth: int = DEPTH, decay: float = DECAY, active: DataFrame | None = None) -> DataFrame:
    """query_id, id, seed, hop, score: nodes reached from ``seeds`` (query_id, id, score), each by the first seed to reach it.

    Seeds go by (score descending, id), neighbours by id, as a queue would.  Neighbours are those that share a group of
    ``members`` (group, id; of ``memberships``): of a query's nodes in a group only the first in turn matters, and the group's members
    are joined to that one, so a group of m nodes gives m rows a query and never m x m.  A node of one group that is entered is
    reached through that one alone, so its rows are final as they are made; only those of several are compared.  What the
    queries enter goes to the members, which are moved once by id, so that rows of queries times nodes are not moved if
    few enough are entered.  With ``active`` (id) other nodes are bridges only.
    """
    turn = lambda s, i: F.struct(s.alias("s"), i.alias("i"))
    members = checkpointed(members)
    frontier = checkpointed(seeds.select("query_id", "id", F.col("id").alias("seed"), "score", F.array(turn(-F.col("score"), F.col("id"))).alias("turn")))
    visited, out = frontier.select("query_id", "id"), None
    for hop in range(1, depth + 1):
        entered = checkpointed(members.join(small_side(frontier), "id").groupBy("query_id", "group").agg(F.min_by(F.struct("seed", "score", "turn"), "turn").alias("m")))
        near = members.join(small_side(entered.select("group").distinct()), "group", "left_semi")
        groups = checkpointed(near.groupBy("id").agg(F.collect_set("group").alias("groups")))
        entered = small_side(entered)
        lone = groups.where("size(groups) = 1").select("id", F.col("groups")[0].alias("group")).join(entered, "group").select("query_id", "id", "m")
        several = groups.where("size(groups) > 1").select("id", F.explode("groups").alias("group")).join(entered, "group").groupBy("query_id", "id").agg(F.min_by("m", "m.turn").alias("m"))
        first = lone.unionByName(several).join(small_side(visited), ["query_id", "id"], "left_anti")
        frontier = first.select("query_id", "id", "m.seed", "m.score", F.concat("m.turn", F.array(turn(F.lit(0.0), F.col("id")))).alias("turn"))
        frontier = checkpointed(frontier) if hop < depth else frontier
        reached = frontier.select("query_id", "id", "seed", F.lit(hop).alias("hop"), F.round(F.col("score") * decay**hop, 6).alias("score"))
        out = reached if out is None else out.unionByName(reached)
        visited = visited.unionByName(frontier.select("query_id", "id"))
    return out if active is None else out.join(active.select("id"), "id", "left_semi")


def worth_expanding(recalled: DataFrame, most: int = CANDIDATES, decay: float = DECAY) -> DataFrame:
    """Those of ``recalled`` (query_id, id, score) whose neighbours can be among the query's ``most`` best: a neighbour scores
    ``decay`` times as much, so it must reach the last of the best that are recalled already, if there are so many."""
    best = top_k(recalled.select("query_id", "id", "score"), most, positive=False).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    least = F.when(F.col("n") >= most, F.col("least"))
    kept = recalled.join(best, "query_id").where(least.isNull() | (F.round(F.col("score") * decay, 6) >= least))
    return kept.select("query_id", "id", "score")


def best_reached(seeds: DataFrame, visited: DataFrame, members: DataFrame, active: DataFrame, most: int = CANDIDATES, decay: float = DECAY) -> DataFrame:
    """What ``expand`` gives at depth 1, but for rows that can't be among a query's ``most`` best.

    ``visited`` (query_id, id) are reached already.  All members that a seed reaches through a group have one score, so of
    the group's active members in order of id only the first ``most`` that aren't visited matter, which are among the first
    ``most`` plus as many as the group has visited ones.  A query gets no more rows from a group than that.
    """
    first = F.min_by(F.struct(F.col("id").alias("seed"), "score"), F.struct(-F.col("score"), "id"))
    entered = checkpointed(seeds.join(members, "id").groupBy("query_id", "group").agg(first.alias("m")))
    groups = members.join(entered.select("group").distinct(), "group", "left_semi").join(active.select("id"), "id", "left_semi").distinct()
    ranked = groups.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("id")))
    known = visited.join(entered.select("query_id").distinct(), "query_id", "left_semi").join(groups, "id").groupBy("query_id", "group").agg(F.count("*").alias("known"))
    lists = checkpointed(entered.join(known, ["query_id", "group"], "left").withColumn("last", F.lit(most) + F.coalesce("known", F.lit(0))))
    met = lists.join(ranked.where(F.col("place") <= (lists.agg(F.max("last")).first()[0] or 0)), "group").where("place <= last").join(visited.select("query_id", "id"), ["query_id", "id"], "left_anti")
    won = met.groupBy("query_id", "id").agg(F.min_by("m", F.struct(-F.col("m.score"), F.col("m.seed"))).alias("m"))
    return won.select("query_id", "id", "m.seed", F.lit(1).alias("hop"), F.round(F.col("m.score") * decay, 6).alias("score"))


def max_normalised(scored: DataFrame) -> DataFrame:
    """Scores divided by the query's best; 0 where that isn't positive."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("score", F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0)))


def fuse(channels: dict[str, DataFrame]) -> DataFrame:
    """query_id, id, score (best of the channels), sources (in order)."""
    parts = [df.select("query_id", "id", "score", F.lit(name).alias("source")) for name, df in channels.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def reranked(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Candidates by an outside score (query_id, id, rerank); a score that is missing counts 0."""
    both = candidates.join(scores, ["query_id", "id"], "left").withColumn("rerank", F.coalesce("rerank", F.lit(0.0)))
    return top_k(both, k, positive=False, score="rerank")


def plan_scores(vectors: DataFrame, nodes: DataFrame, k: int = RECALL_K) -> DataFrame:
    """query_id, id, score: the best of each plan's query ``vectors`` (query_id, part, vector) on each node (id, vector), as
    (cosine + 1) / 2; only rows that can be among a query's ``k`` best."""
    kind = dict(vectors.dtypes)["query_id"]
    parts = vectors.select(F.concat_ws(chr(1), "query_id", "part").alias("query_id"), "vector")
    best = vector_scores(parts, nodes, k).withColumn("query_id", F.substring_index("query_id", chr(1), 1).cast(kind))
    return best.groupBy("query_id", "id").agg(F.round((F.max("score") + 1) / 2, 7).alias("score"))


def hybrid_retrieve(plans: DataFrame, vectors: DataFrame, nodes: DataFrame, node_vectors: DataFrame, rerank=None, k: int = 5, recall_k: int = RECALL_K, most: int = CANDIDATES, depth: int = DEPTH) -> DataFrame:
    """query_id, id, score, rank, recall_score, sources, seed, hop of each query's ``k`` best memories.

    ``plans``: query_id, query, rewritten_query, keywords, tags; ``vectors``: query_id, part, vector; ``nodes``: id, content,
    tags, provenance, status; ``node_vectors``: id, vector.  BM25 (over query, rewritten query, keywords and tags, divided by the
    best) and vectors each recall ``recall_k`` active nodes, metadata any number; all of them are seeds of the graph, where
    archived nodes are bridges only.  Of metadata's only the first ``most`` by id are kept: a match scores 1, the highest there
    is, so with more of them no later match and no neighbour, which scores less, is among the ``most`` best.  The ``most`` best go to ``rerank(candidates)``, which gives query_id, id, rerank from
    (query_id, id, rewritten_query, content); without one the recalled score counts.
    """
    active = nodes.where("status = 'active'")
    asked = plans.select("query_id", F.concat_ws(" ", "query", "rewritten_query", F.array_join("keywords", " "), F.array_join("tags", " ")).alias("query"))
    cut = lambda df: top_k(df, recall_k).select("query_id", "id", "score")
    lexical = cut(max_normalised(bm25(asked, active, k=recall_k)))
    dense = cut(plan_scores(vectors, node_vectors.join(active.select("id"), "id", "left_semi"), recall_k))
    recalled = checkpointed(fuse({"bm25": lexical, "embedding": dense, "metadata": metadata_matches(plans, active, most)}))
    whole = recalled.select("query_id", "id", "score")
    if depth == 1:
        reached = best_reached(worth_expanding(whole, most), whole, memberships(nodes), active, most)
    else:
        reached = expand(whole, memberships(nodes), depth, active=active)
    graph = checkpointed(reached)
    reached = graph.select("query_id", "id", "score", F.array(F.lit("graph")).alias("sources"))
    both = recalled.unionByName(reached).groupBy("query_id", "id").agg(F.round(F.max("score"), 7).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    few = checkpointed(top_k(both, most, positive=False).withColumnRenamed("score", "recall_score").drop("rank"))
    shown = active.select("id", "content").join(small_side(few.join(plans.select("query_id", "rewritten_query"), "query_id")), "id")  # texts stay where they are
    scores = few.select("query_id", "id", F.col("recall_score").alias("rerank")) if rerank is None else rerank(shown)
    ranked = reranked(few, scores, k).withColumnRenamed("rerank", "score")
    return ranked.join(graph.select("query_id", "id", "seed", "hop"), ["query_id", "id"], "left").select("query_id", "id", "score", "rank", "recall_score", "sources", "seed", F.coalesce("hop", F.lit(0)).alias("hop"))
