"""Lexical and dense retrieval, rank fusion and reranking."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..shared import written


def ranked(scores: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 within `by`; the first k if given (Spark limits each group before the shuffle)."""
    out = scores.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf); counts are combined before the shuffle, as a document's terms lie in one task."""
    rows = docs.select(F.col(key).alias("doc_id"), F.explode(terms(F.col(text))).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


#: (query, term) pairs that may be sent to every task (a few MB); beyond it postings are shuffled to them.
BROADCAST_TERMS = 200_000
#: Hits (a topic's term in a document) from which on contenders are looked for first; fewer are scored outright,
#: in one pass that costs less than the passes that find bounds.  Either way gives the same rows.
PRUNE_FROM = 50_000_000
#: Hits, and documents times queries, that are scored in one array.
CELLS = 1 << 20
#: Times as many hits from which on contenders are looked for where arrays score: for 51 million hits that took three
#: times as long as scoring all by arrays.
ARRAYS = 100
#: Hits that one task scores.
HITS_OF_A_TASK = 2_000_000
#: The share of hits that terms left by the bounds may have; with more, meeting them and then scoring what they
#: find in full costs more than scoring all outright.  Either way gives the same rows.
PRUNE_TO = 0.1
#: Documents, in multiples of k, whose full scores give a query's first lower bound.
SEEDS = 4
#: Scores are rounded to six places, so bounds are slackened by more than that.
SLACK = 2e-6


@dataclass(frozen=True)
class Index:
    """What scoring needs of each field of the documents, for one set of topics; written out, so it is searched any number of times."""

    asked: DataFrame  # (field, query_id, term, qtf, idf, n): n documents have the term
    rows: DataFrame  # (field, doc_id, dl, entries): the asked terms of a document's field, and how often it has each
    lengths: dict[str, float]  # mean terms of a field
    few: bool  # asked pairs may be broadcast


def _fielded(docs: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """(doc_id, field, t): the terms of each field of each document."""
    parts = F.array(*[F.struct(F.lit(name).alias("field"), terms(F.col(c)).alias("t")) for name, c in fields.items()])
    return docs.select(F.col(key).alias("doc_id"), F.explode(parts).alias("f")).select("doc_id", "f.*")


_TERM = re.compile("[a-z0-9]+")
#: Distinct terms that a task counts before it gives what it has.
TERMS_OF_A_TASK = 1 << 19


def _lowered(docs: DataFrame, fields: Mapping[str, str], *keys: Column) -> DataFrame:
    return docs.select(*keys, *[F.lower(F.coalesce(c, F.lit(""))).alias(f"f{i}") for i, c in enumerate(fields.values())])


def _counted(docs: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """(field, term, n, dl): documents with each term of a field, counted by task; the term '' has all documents, and their terms as dl."""
    names = list(fields)

    def given(field: str, counts: Counter, n: int, dl: int) -> pa.RecordBatch:
        terms, numbers = [*counts, ""], [*counts.values(), n]
        return pa.RecordBatch.from_arrays([pa.array([field] * len(terms)), pa.array(terms, pa.string()), pa.array(numbers, pa.int64()), pa.array([None] * len(counts) + [dl], pa.int64())], names=["field", "term", "n", "dl"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {f: [Counter(), 0, 0] for f in names}
        for b in batches:
            for i, f in enumerate(names):
                for text in b.column(i):
                    found = _TERM.findall(text.as_py())
                    own = held[f]
                    own[0].update(set(found))
                    own[1] += 1
                    own[2] += len(found)
                    if len(own[0]) > TERMS_OF_A_TASK:
                        yield given(f, *own)
                        held[f] = [Counter(), 0, 0]
        for f, own in held.items():
            if own[1]:
                yield given(f, *own)

    return _lowered(docs, fields).mapInArrow(run, "field string, term string, n long, dl long")


def _asked_postings(docs: DataFrame, key: str, fields: Mapping[str, str], sought: DataFrame) -> DataFrame:
    """(doc_id, field, dl, entries) of every row that has asked terms; these are few, and go to where the texts are."""
    names, asked = list(fields), {f: set() for f in fields}
    for r in sought.collect():
        asked[r["field"]].add(r["term"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, f in enumerate(names):
                rows, dl, ends, terms, tf = [], [], [0], [], []
                for at, text in enumerate(b.column(i + 1)):
                    found = _TERM.findall(text.as_py())
                    counts = Counter(filter(asked[f].__contains__, found))
                    if counts:
                        rows.append(at)
                        dl.append(len(found))
                        terms += counts
                        tf += counts.values()
                        ends.append(len(terms))
                entries = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tf, pa.float64())], names=["term", "tf"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([f] * len(rows), pa.string()), pa.array(dl, pa.int32()), lists], names=["doc_id", "field", "dl", "entries"])

    rows = _lowered(docs, fields, F.col(key).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, field string, dl int, entries array<struct<term: string, tf: double>>")


def _merged(rows: DataFrame) -> DataFrame:
    """The postings by doc_id; rows of one key and length are one document, its counts added up."""
    one = rows.repartition("doc_id").groupBy("doc_id", "field", "dl").agg(F.collect_list("entries").alias("_all"))
    flat = F.flatten("_all")
    total = lambda t: F.aggregate(F.filter(flat, lambda e: e["term"] == t), F.lit(0.0), lambda a, e: a + e["tf"])
    several = F.transform(F.array_distinct(F.transform(flat, lambda e: e["term"])), lambda t: F.struct(t.alias("term"), total(t).alias("tf")))
    return one.select("doc_id", "field", "dl", F.when(F.size("_all") == 1, F.col("_all")[0]).otherwise(several).alias("entries"))


def index(docs: DataFrame, topics: DataFrame, fields: Mapping[str, str] | None = None, key: str = "doc_id", topic: str = "query_id", epsilon: float = 0.25) -> Index:
    """The topics' terms with their weight in each field, and the documents' postings of them.

    `fields` maps names to text columns; statistics are a field's own.  idf is
    ln((N - n + .5) / (n + .5)), a negative one epsilon times the mean of the field's
    vocabulary.  All fields are read together, twice: for the vocabulary, and for the
    postings of asked terms only, so nothing else is shuffled or kept.
    """
    fields = dict(fields or {"text": "text"})
    vocab = written(_counted(docs, fields).groupBy("field", "term").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")), "vocabulary")
    sizes = vocab.where("term = ''").select("field", F.col("n").alias("n_docs"), (F.col("dl") / F.col("n")).alias("mean_length"))
    words = vocab.where("term <> ''").join(F.broadcast(sizes), "field")
    words = words.withColumn("raw", F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    means = words.groupBy("field").agg(F.avg("raw").alias("mean"))
    asks = topics.select(F.col(topic).alias("query_id"), F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    idf = words.join(F.broadcast(means), "field").select("field", "term", "n", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = written(asks.join(idf, "term").select("field", "query_id", "term", "qtf", "idf", "n"), "asked")
    few = asked.count() <= BROADCAST_TERMS
    sought = asked.select("field", "term").distinct()
    if few:
        rows = _merged(_asked_postings(docs, key, fields, sought))
    else:
        tokens = _fielded(docs, key, fields).select("doc_id", "field", F.size("t").alias("dl"), F.explode("t").alias("term"))
        found = tokens.join(sought, ["field", "term"], "left_semi").groupBy("doc_id", "field", "dl", "term").agg(F.count("*").alias("tf"))
        rows = found.repartition("doc_id").groupBy("doc_id", "field", "dl").agg(F.collect_list(F.struct("term", F.col("tf").cast("double").alias("tf"))).alias("entries"))
    return Index(asked, written(rows, "postings"), {r["field"]: r["mean_length"] for r in sizes.collect()}, few)


class _Scoring:
    """One setting of an index's field: the parts of scores, and the bounds that leave documents out."""

    def __init__(self, ix: Index, field: str, k1: float, b: float):
        mean = ix.lengths.get(field) or 1.0
        self.k1, self.b, self.mean = k1, b, mean
        self.norm = lambda dl: k1 * (1 - b + b * dl / F.lit(mean))
        self.part = lambda tf, dl: tf * (k1 + 1) / (tf + self.norm(dl))
        self.few = ix.few
        self.asks = ix.asked.where(F.col("field") == field).select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "n")
        self.rows = ix.rows.where(F.col("field") == field).select("doc_id", "dl", "entries")
        self.least, self.n_hits = self.asks.agg(F.min("w"), F.sum("n")).first()
        # dealt by hits, not left to adaptive execution, which goes by bytes: few bytes of postings give very many hits
        tasks = max(1, -(-(self.n_hits or 0) // HITS_OF_A_TASK))
        self.dealt = self.rows.repartition(tasks, "doc_id")
        self.parts = self.dealt.select("doc_id", "dl", F.explode("entries").alias("e")).select("doc_id", F.col("e.term").alias("term"), self.part(F.col("e.tf"), F.col("dl")).alias("part"))

    def near(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def hits(self, asks: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of every document with one of the asked terms, summed where a document's postings are."""
        met = self.parts.join(self.near(asks), "term")
        return met.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score"))

    def arrays(self) -> bool:
        """Whether hits can be scored by arrays: the asked terms are few, and each document stands in one row."""
        return self.few and not self.rows.groupBy("doc_id").count().where("count > 1").limit(1).count()

    def outright(self, k: int | None) -> DataFrame:
        """(query_id, doc_id, score) of all hits, or of those that may be among a query's k best; the asked terms are few.

        A document's postings meet the queries of their terms in arrays of documents by
        queries.  A task keeps each query's k best so far, and all within rounding of the
        k-th, so that ties are settled over all documents.
        """
        asks = self.asks.select("query_id", "term", "w").toArrow().sort_by("term")
        words, at = np.unique(asks.column("term").to_numpy(zero_copy_only=False).astype(str), return_index=True)
        at = np.append(at, asks.num_rows)
        weight, ids = asks.column("w").to_numpy(), asks.column("query_id").unique()
        of = pc.index_in(asks.column("query_id"), value_set=ids).to_numpy().astype(np.int64)
        k1, b, mean, width = self.k1, self.b, self.mean, len(ids)
        vocabulary, ids = pa.array(words.tolist(), pa.string()), ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floor = np.full(width, -np.inf)
            for batch in batches:
                if not batch.num_rows or not width:
                    continue
                lists = batch.column("entries")
                flat = lists.flatten()
                code = pc.index_in(flat.field(0), value_set=vocabulary).to_numpy(zero_copy_only=False)
                dl, tf = batch.column("dl").to_numpy().astype(float), flat.field(1).to_numpy()
                sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(dl)), sizes)
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / mean))
                code = code.astype(np.int64)
                met = at[code + 1] - at[code]
                ends = np.append(0, np.cumsum(sizes))
                work = np.append(0, np.cumsum(met))[ends]  # hits before each document
                lo = 0
                while lo < len(dl):
                    hi = min(int(np.searchsorted(work, work[lo] + CELLS, "right")) - 1, lo + CELLS // width, len(dl))
                    hi = max(lo + 1, hi)
                    own = slice(ends[lo], ends[hi])
                    n = met[own]
                    hit = np.repeat(at[code[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    cell = np.repeat((doc[own] - lo) * width, n) + of[hit]
                    score = np.bincount(cell, np.repeat(part[own], n) * weight[hit], (hi - lo) * width).reshape(-1, width)
                    kept = np.zeros(score.shape, bool)
                    kept.reshape(-1)[cell] = True
                    if k is not None:
                        score[~kept] = -np.inf
                        if hi - lo >= k:
                            floor = np.maximum(floor, np.partition(score, -k, axis=0)[-k] - SLACK)
                        kept &= score >= floor
                    x, y = np.nonzero(kept)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(y)), batch.column("doc_id").take(pa.array(x + lo)), pa.array(score[x, y])], names=["query_id", "doc_id", "score"])
                    lo = hi

        kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((self.asks, "query_id"), (self.rows, "doc_id"))]
        return self.dealt.select("doc_id", "dl", "entries").mapInArrow(run, ", ".join([*kinds, "score double"]))

    def full(self, pairs: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of the distinct pairs (query_id, doc_id)."""
        own = self.rows.join(pairs.select("query_id", "doc_id"), "doc_id").select("query_id", "doc_id", "dl", F.explode("entries").alias("e"))
        met = own.select("query_id", "doc_id", F.col("e.term").alias("term"), self.part(F.col("e.tf"), F.col("dl")).alias("part")).join(self.near(self.asks), ["query_id", "term"])
        return met.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score"))

    def bounds(self, k: int) -> DataFrame:
        """(query_id, term, w, n, most, reach, out): the asked terms, and which of them needn't be met to find the k best.

        A term adds at most its weight times its greatest part.  The full scores of a
        few documents with a query's rarest terms give a score that k documents reach.
        Terms whose bounds together stay below it are left out of the search: a
        document with no other term can't be among the k best.
        """
        top = self.parts.groupBy("term").agg(F.max("part").alias("top"))
        asks = written(self.asks.join(top, "term").withColumn("most", F.col("w") * F.col("top")), "bounds")
        rare = Window.partitionBy("query_id").orderBy("n", "term").rowsBetween(Window.unboundedPreceding, -1)
        seeds = asks.withColumn("_before", F.coalesce(F.sum("n").over(rare), F.lit(0))).where(F.col("_before") < SEEDS * k)
        best = ranked(self.hits(seeds.select("query_id", "term", "w")), ["query_id"], [F.desc("score"), F.asc("doc_id")], SEEDS * k)
        known = ranked(self.full(best), ["query_id"], [F.desc("score")], k)
        reach = known.where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("reach"))
        low = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        split = asks.join(reach, "query_id", "left").withColumn("_sum", F.sum("most").over(low))
        return written(split.withColumn("out", F.coalesce(F.col("_sum") < F.col("reach"), F.lit(False))), "split")

    def pruned(self, k: int, split: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(pairs that may reach their query's k best, weights of the terms that had to be met to find them).

        Of the documents found by the terms that `bounds` leaves, such stay as reach
        the known score with the bounds of the terms left out.
        """
        split = self.bounds(k) if split is None else split
        need = split.where("NOT out").select("query_id", "term", "w")
        rest = split.groupBy("query_id").agg(F.coalesce(F.first("reach"), F.lit(0.0)).alias("reach"), F.sum(F.when(F.col("out"), F.col("most")).otherwise(0.0)).alias("rest"))
        found = self.hits(need).join(self.near(rest), "query_id")
        return found.where("score + rest >= reach").select("query_id", "doc_id"), need


def search(ix: Index, k: int | None = None, field: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank) of documents that share a term with the topic in this field; the k best if given.

    With k and `PRUNE_FROM` hits only contenders are scored in full (`_Scoring.pruned`),
    unless the bounds leave too many hits (`PRUNE_TO`); the rows are those of the full ranking.  Ties go to the smaller document id.
    """
    scoring = _Scoring(ix, field, k1, b)
    least, hits = scoring.least, scoring.n_hits
    # bounds need weights that never lower a score
    arrays = scoring.arrays()
    outright = k is None or hits is None or hits < PRUNE_FROM * (ARRAYS if arrays else 1) or least < 0
    if not outright:
        split = scoring.bounds(k)
        outright = (split.where("NOT out").agg(F.sum("n")).first()[0] or 0) > PRUNE_TO * hits
    if outright:
        scores = scoring.outright(k) if arrays else scoring.hits(scoring.asks)
    else:
        scores = scoring.full(scoring.pruned(k, split)[0])
    scores = scores.select("query_id", "doc_id", F.round("score", 6).alias("score"))
    return ranked(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def bm25(docs: DataFrame, topics: DataFrame, k: int | None = None, key: str = "doc_id", text: str = "text", topic: str = "query_id", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """One search of one field.  A term that a topic repeats counts as often; documents without a shared term aren't listed."""
    return search(index(docs, topics, {"text": text}, key, topic, epsilon), k, k1=k1, b=b)


def fused(runs: Sequence[DataFrame], k: int | None = 1000, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, doc_id, rank) runs."""
    union = runs[0].select("query_id", "doc_id", "rank")
    for r in runs[1:]:
        union = union.unionByName(r.select("query_id", "doc_id", "rank"))
    scores = union.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 9).alias("score"))
    return ranked(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


#: Query vectors that are searched for in one reading of the vectors (64 doubles each: some 5 MB); more are taken in blocks.
QUERIES_AT_ONCE = 10_000


def _unit(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold numbers only and as many as the first such row, these as unit vectors); a zero vector stays."""
    rows = [np.array(v, float) if v is not None and None not in v else None for v in vectors.to_pylist()]
    width = next((len(v) for v in rows if v is not None), 0)
    kept = [i for i, v in enumerate(rows) if v is not None and len(v) == width and np.isfinite(v).all()]
    m = np.array([rows[i] for i in kept]).reshape(len(kept), width)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.array(kept, int), m / np.where(norm > 0, norm, 1.0)


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score, rank): exact inner products of unit vectors, negative ids left out.

    `queries` is a stated set, searched for in blocks of `QUERIES_AT_ONCE`.  A block goes
    to where the vectors are; a batch of vectors meets it as a product of two matrices
    and returns each query's k best of the batch, so what is shuffled is k rows for a
    query and batch.  Vectors that are null or hold a null or infinite number take no part.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    rows = vectors.where(F.col(key) >= 0).select(F.col(key).cast("long").alias("doc_id"), F.col(vector).alias("v"))
    asked = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("v")).where("query_id IS NOT NULL")
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        kept, q = _unit(part.column("v").combine_chunks())
        ids = part.column("query_id").to_numpy()[kept]

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, v = _unit(b.column("v"))
                if not len(at) or not len(ids) or v.shape[1] != q.shape[1]:
                    continue
                docs = b.column("doc_id").to_numpy()[at]
                scores = q @ v.T
                if len(docs) > k:  # all within rounding of the k-th stay, so that ties are settled over all vectors
                    least = np.partition(scores, -k, axis=1)[:, -k] - SLACK
                    x, y = np.nonzero(scores >= least[:, None])
                else:
                    x, y = np.divmod(np.arange(scores.size), len(docs))
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(docs[y]), pa.array(scores[x, y])], names=["query_id", "doc_id", "score"])

        found = rows.mapInArrow(run, "query_id long, doc_id long, score double")
        out = found if out is None else out.unionAll(found)
    return ranked(out.withColumn("score", F.round("score", 6)), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def overlap_scorer(query: Column, text: Column) -> Column:
    """The default pair scorer: the share of the query's distinct terms that the text has."""
    q = F.array_distinct(terms(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, terms(text))).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def reranked(candidates: DataFrame, topics: DataFrame, docs: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_scorer, k: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Candidates by the scorer of (topic text, document text), ties by their first rank; a missing document is empty text."""
    t = topics.select("query_id", F.col("text").alias("_q"))
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_d"))
    rows = d.join(candidates.select("query_id", "doc_id", F.col("rank").alias("first_rank")), "doc_id", "right").join(t, "query_id")
    scores = rows.select("query_id", "doc_id", "first_rank", F.round(scorer(F.col("_q"), F.coalesce("_d", F.lit(""))), 6).alias("score"))
    return ranked(scores, ["query_id"], [F.desc("score"), F.asc("first_rank"), F.asc("doc_id")], k)


def concatenated(passages: DataFrame, key: str = "doc_id", order: str = "i", text: str = "passage_text") -> DataFrame:
    """(key, text): each document's passages in order, joined by spaces."""
    rows = passages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_p"))
    return rows.select(key, F.array_join(F.transform("_p", lambda x: x[text]), " ").alias("text"))


def passage_search(run: DataFrame, passages: DataFrame, topics: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_scorer, docs: int = 20, k: int = 8, key: str = "doc_id", text: str = "passage_text") -> DataFrame:
    """The k best passages of the topic's first `docs` documents: by the scorer, then the document's score, then passage id.

    Two stages: only passages of documents that the run holds are scored.
    """
    top = run.where(F.col("rank") <= docs).select("query_id", F.col(key), F.col("score").alias("doc_score"), F.col("rank").alias("doc_rank"))
    rows = passages.join(top, key).join(topics.select("query_id", F.col("text").alias("_q")), "query_id")
    scored = rows.select("query_id", key, "passage_id", "doc_rank", "doc_score", F.round(scorer(F.col("_q"), F.col(text)), 6).alias("score"))
    return ranked(scored, ["query_id"], [F.desc("score"), F.desc("doc_score"), F.asc("passage_id")], k)


def compared(summaries: dict[str, DataFrame], metrics: Sequence[str]) -> DataFrame:
    """One-row summaries as one table: method, then the metrics rounded to four places."""
    rows = [s.select(F.lit(name).alias("method"), *[F.round(m, 4).alias(m) for m in metrics]) for name, s in summaries.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
