"""BM25, vector and fused ranking over an inverted index kept in tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, search_tokens
from ..functions.vectors import cosine, doubles
from ..session import written

#: Saturation, length normalisation, fusion constant, similarity gate.
K1, B, RRF_K, GATE = 1.5, 0.75, 60, 0.62

#: Query terms that are broadcast at most (about 50 MB); more are joined by a shuffle.
BROADCAST_TERMS = 500_000


#: Pairs of query and document that a task adds up, about, and partitions at most.
TASK_PAIRS, MOST_PARTITIONS = 1_000_000, 20_000

#: Folders of a stored index that a term's postings may be in; a query reads those of its terms.
BUCKETS = 64


@dataclass
class Index:
    """postings(id, term, tf, dl), lengths(id, dl), terms(term, df, idf), stats(n, total, avgdl).

    A stored index is a folder of segments, one for each lot of documents; their counts are added up
    when it is opened, so new documents are a new segment and nothing is written again. Ids are those
    of different documents.
    """

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame

    def save(self, path: str, segment: str = "0") -> None:
        """Write as a segment that is not there yet."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS))
        postings = self.postings.select("id", "term", "tf", "dl", bucket.alias("bucket")).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term")
        postings.write.partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
        self.lengths.write.parquet(f"{path}/lengths/segment={segment}")
        self.terms.select("term", "df").write.parquet(f"{path}/terms/segment={segment}")
        self.stats.select("n", "total").write.parquet(f"{path}/stats/segment={segment}")

    @staticmethod
    def load(spark, path: str, terms: DataFrame | None = None) -> Index:
        """Open all segments; with ``terms`` (term) only the folders of those terms are read."""
        postings, lengths, known, stats = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "lengths", "terms", "stats"))
        if terms is not None:  # at most BUCKETS numbers
            asked = [r.b for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("b")).distinct().collect()]
            postings = postings.filter(F.col("bucket").isin(asked))
        stats = stats.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("avgdl", F.try_divide("total", "n"))
        df = known.groupBy("term").agg(F.sum("df").alias("df"))
        return Index(postings.select("id", "term", "tf", "dl"), lengths.select("id", "dl"), _weighted(df, stats), stats)


def _weighted(df: DataFrame, stats: DataFrame) -> DataFrame:
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(F.broadcast(stats)).select("term", "df", idf.alias("idf"))


def counted(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, dl, terms, tfs: each document's terms and how often they stand in it, counted within the row.

    A written table: the texts are read and split once, and nothing is shuffled.
    """

    def runs(tokens: Column) -> Column:
        def ends(t: Column) -> Column:
            places = F.sequence(F.lit(1), F.size(t) + 1)  # one beyond, so that an empty list has none to compare
            return F.filter(places, lambda i: (i <= F.size(t)) & ~F.get(t, i - 1).eqNullSafe(F.get(t, i)))

        def rows(t: Column, e: Column) -> Column:
            terms = F.transform(e, lambda i: F.get(t, i - 1))
            tfs = F.transform(e, lambda i, k: (i - F.when(k == 0, 0).otherwise(F.get(e, k - 1))).cast("long"))
            return F.struct(F.size(t).cast("long").alias("dl"), terms.alias("terms"), tfs.alias("tfs"))

        return let(F.array_sort(tokens), lambda t: let(ends(t), lambda e: rows(t, e)))

    found = docs.select(F.col(id_).alias("id"), runs(search_tokens(F.coalesce(text, F.lit("")))).alias("x"))
    return written(found.select("id", "x.dl", "x.terms", "x.tfs"), "counted")


def build_index(docs: DataFrame, id_: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> Index:
    """Index of whole texts; ``terms`` (term) keeps only postings of those terms (lengths count all).

    Everything comes from one written table of counts. Postings carry their document's length, so
    scoring joins no table of documents. Ids must be unique.
    """
    rows = counted(docs, id_, text)
    lengths = rows.select("id", "dl")
    stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.avg("dl").alias("avgdl"))
    postings = rows.select("id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("id", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"), "dl")
    if terms is not None:
        wanted = terms.select("term").distinct()
        # Counted first: a bounded list goes to every task, so that other postings are never shuffled.
        few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        postings = written(postings.join(F.broadcast(wanted) if few else wanted, "term", "left_semi").select("id", "term", "tf", "dl"), "postings")
    return Index(postings, lengths, _weighted(postings.groupBy("term").agg(F.count("*").alias("df")), stats), stats)


def scores(index: Index, query_terms: DataFrame) -> DataFrame:
    """query_id, id, score of matching documents; a term counts as often as the query holds it.

    query_terms: query_id, term. The terms asked meet their idf first, which is small; that side
    then meets the postings. The one-row statistics are broadcast, and so are up to ``BROADCAST_TERMS`` terms asked.
    """
    counted = query_terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = counted.join(index.terms.select("term", "idf"), "term").join(F.broadcast(index.stats.select("avgdl")))
    size = query_terms.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries")).first()
    if 0 < size.n <= BROADCAST_TERMS:
        # Postings are dealt by document and then meet the terms asked, so a pair of query and document is made and added
        # up in one task: what is shuffled is the postings, not every pair.
        pairs = size.queries * (index.stats.first().n or 0)
        parts = min(MOST_PARTITIONS, max(int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // TASK_PAIRS))
        hits = index.postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").repartition(parts, "id").join(F.broadcast(asked), "term")
    else:
        hits = index.postings.join(asked, "term")
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def query_terms(queries: DataFrame, id_: str, text: str) -> DataFrame:
    return queries.select(F.col(id_).alias("query_id"), F.explode(search_tokens(F.col(text))).alias("term"))


def ranked(scored: DataFrame, k: int, score: str = "score", id_: str = "id") -> DataFrame:
    """Adds rank from 1 and keeps k per query; ties to the smaller id. The limit applies map-side too."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), id_)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, id_: str = "doc_id", text: str = "text", query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """Best k documents of each query, by an index of the query terms alone."""
    terms = query_terms(queries, query_id, query_text)
    return ranked(scores(build_index(docs, id_, text, terms), terms), k)


def ranked_with_zeros(index: Index, scored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``ranked`` over all documents, unmatched ones with score 0, for every row (query_id) of ``queries``.

    A query with fewer than k matches is filled up with the smallest ids that it lacks; they are
    among the k smallest of all, so no document meets a query beyond those.
    """
    top = written(ranked(scored, k).select("query_id", "id", "score"), "top")
    found = top.groupBy("query_id").agg(F.count("*").alias("found"))
    short = queries.select("query_id").distinct().join(found, "query_id", "left").filter(F.coalesce("found", F.lit(0)) < k).select("query_id")
    first = index.lengths.select("id").orderBy("id").limit(k)
    fill = short.join(F.broadcast(first)).join(top, ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(top.unionByName(fill.select("query_id", "id", "score")), k)


def embedded_queries(queries: DataFrame, embed, translate=None, text: str = "query") -> DataFrame:
    """Adds ``vector``: the query, translated for this leg only, then embedded (both column functions)."""
    asked = F.col(text)
    return queries.withColumn("vector", embed(translate(asked) if translate else asked))


def vector_scores(vectors: DataFrame, query: Column, id_: str, vector: str) -> DataFrame:
    """id, score by cosine with one query vector given as a literal column."""
    return vectors.select(F.col(id_).alias("id"), cosine(doubles(F.col(vector)), query).alias("score"))


def rrf(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, id, fused score from rows (query_id, leg, id, rank)."""
    return rankings.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def hybrid(lexical: DataFrame, vector: DataFrame | None, k: int, threshold: float = GATE, rrf_k: int = RRF_K) -> DataFrame:
    """Fused top k per query: query_id, id, score, bm25_rank, vec_rank, similarity, rank.

    lexical, vector: query_id, id, score. Each leg gives max(4k, 20) ranks. With a vector leg,
    documents under ``threshold`` are dropped (a missing similarity counts as 0). Ties keep the
    lexical order, then the vector order.
    """
    depth = max(4 * k, 20)
    lex = ranked(lexical, depth).select("query_id", "id", F.col("rank").alias("bm25_rank"))
    if vector is None:
        fused = lex.withColumns({"vec_rank": F.lit(None).cast("int"), "similarity": F.lit(None).cast("double")})
    else:
        vec = ranked(vector, depth).select("query_id", "id", F.col("rank").alias("vec_rank"))
        fused = lex.join(vec, ["query_id", "id"], "full")
        near = vector.select("query_id", "id", F.col("score").alias("similarity")).join(fused.select("query_id", "id"), ["query_id", "id"], "left_semi")
        fused = fused.join(near, ["query_id", "id"], "left").filter(F.coalesce("similarity", F.lit(0.0)) >= threshold)
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    fused = fused.withColumn("score", part("bm25_rank") + part("vec_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vec_rank"))
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def status(corpus_path: str | None, exists: bool, failed: bool = False) -> str:
    """Never silently empty: why a search gives nothing."""
    return "no_corpus_configured" if not corpus_path else "corpus_missing" if not exists else "search_failed" if failed else "ok"


def conversation_context(results: DataFrame, most: int = 3) -> DataFrame:
    """query_id, context: the best pairs of each query as text, joined by a rule."""
    top = results.filter(F.col("rank") <= most)
    line = F.concat(F.lit("Q: "), F.col("instruction"), F.lit("\nA: "), F.col("response"))
    rows = top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("rows"))
    return rows.select("query_id", F.array_join(F.col("rows.line"), "\n---\n").alias("context"))
