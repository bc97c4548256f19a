"""Hybrid search: BM25 and hashed vectors over node texts, fused by reciprocal rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import fnv1a, tokens
from codeloom.functions.rules import CONCEPTS
from codeloom.runtime import cut, ranked, small

# BM25, fusion and vector parameters.
K1, B, RRF_K, NO_RANK, DIMENSIONS, LEAST_COSINE = 1.5, 0.75, 60, 1000, 256, 0.05
TOKEN_WEIGHT, TRIGRAM_WEIGHT, TOKEN_SIGN, TRIGRAM_SEED, TRIGRAM_SIGN = 1.5, 0.5, 1, 42, 99
FAVOURED = ["component", "api-endpoint", "service", "database-table"]
#: Corpora of fewer documents are compared with the query's vector as a whole.
DENSE_ALL = 500


def expand_terms(spark: SparkSession, query: str) -> DataFrame:
    """term: the query's terms, and the concept and first four words of every concept that one of them belongs to."""
    one = spark.createDataFrame([(query,)], "q string").select(F.explode(tokens("q")).alias("term")).distinct()
    words = F.broadcast(spark.createDataFrame([(c, w, i) for c, ws in CONCEPTS.items() for i, w in enumerate([c, *ws])], "concept string, word string, place int"))  # a fixed table
    hit = one.join(words, one.term == words.word).select("concept").distinct()
    more = words.join(hit, "concept", "left_semi").filter("place <= 4").select(F.col("word").alias("term"))
    return one.unionByName(more).distinct()


def node_texts(nodes: DataFrame) -> DataFrame:
    """id, type, name, text: what a node is found by."""
    return nodes.select("id", "type", "name", F.concat_ws(" ", "name", "qualified_name", "description", "type", "file_path").alias("text"))


def postings(texts: DataFrame) -> DataFrame:
    """id, term, tf, len. Counted in each text before anything is shuffled: a text's terms stay in its row."""
    t = texts.select("id", tokens("text").alias("ts")).withColumn("len", F.size("ts"))
    return t.select("id", "len", F.explode("ts").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "len")


def bm25(posts: DataFrame, texts: DataFrame, terms: DataFrame) -> DataFrame:
    """id, score, n_terms of the texts that hold a term."""
    stats = texts.select(F.size(tokens("text")).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len")).first()  # one row of corpus statistics
    hits = cut(posts.join(small(cut(terms)), "term"))
    df = hits.groupBy("term").agg(F.countDistinct("id").alias("df"))
    n, a, f = F.lit(stats.n_docs), F.lit(float(stats.avg_len or 1)), F.col("df")
    idf = F.log(1 + (n - f + 0.5) / (f + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / a))
    return hits.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(weight).alias("score"), F.count("*").alias("n_terms"))  # df: one row a query term


def vectors(texts: DataFrame) -> DataFrame:
    """id, dim, w: the non-zero places of each text's unit vector of hashed terms and trigrams, summed as doubles."""
    t = texts.select("id", F.explode(tokens("text")).alias("t")).groupBy("id", "t").agg(F.count("*").alias("n"))
    # each term is hashed once, however many texts hold it
    terms = cut(texts.select(F.explode(tokens("text")).alias("t")).distinct())
    sign = lambda h: F.when(h % 2 == 0, 1.0).otherwise(-1.0)
    whole = terms.select("t", (fnv1a("t") % DIMENSIONS).alias("dim"), (sign(fnv1a("t", TOKEN_SIGN)) * TOKEN_WEIGHT).alias("w"))
    tri = terms.filter(F.length("t") >= 3).select("t", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3)))).alias("g")).groupBy("t", "g").agg(F.count("*").alias("m"))
    grams = tri.select("g").distinct().select("g", (fnv1a("g", TRIGRAM_SEED) % DIMENSIONS).alias("dim"), (sign(fnv1a("g", TRIGRAM_SIGN)) * TRIGRAM_WEIGHT).alias("v"))
    tri = tri.join(grams, "g").select("t", "dim", (F.col("v") * F.col("m")).alias("w"))
    places = cut(whole.unionByName(tri).groupBy("t", "dim").agg(F.sum("w").alias("w")))
    summed = t.join(places, "t").groupBy("id", "dim").agg(F.sum(F.col("w") * F.col("n")).alias("w")).filter("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return summed.select("id", F.col("dim").cast("int").alias("dim"), (F.col("w") / norm).alias("w"))


def cosine(vecs: DataFrame, query: str) -> DataFrame:
    """id, sim of the texts whose vector has a cosine of at least 0 with the query's."""
    spark = vecs.sparkSession
    q = vectors(spark.createDataFrame([("q", query)], "id string, text string")).select("dim", F.col("w").alias("qw"))
    return vecs.join(F.broadcast(q), "dim").groupBy("id").agg(F.greatest(F.lit(0.0), F.sum(F.col("w") * F.col("qw"))).alias("sim"))  # at most 256 rows


def hybrid_search(nodes: DataFrame, query: str, limit: int = 20, types: list[str] | None = None, min_score: float = 0.05, dense_all: bool = False) -> DataFrame:
    """id, bm25, dense, score of the best nodes: ranks of both channels fused, exact and similar names favoured.

    From DENSE_ALL texts on, the dense channel takes the texts that hold a query term
    only, as the public behaviour has it; dense_all takes all texts whatever their
    number. Ties go by id.
    A query without terms finds nothing.
    """
    spark = nodes.sparkSession
    texts = cut(node_texts(nodes))
    lexical = cut(bm25(postings(texts), texts, expand_terms(spark, query)))
    whole = dense_all or texts.limit(DENSE_ALL).count() < DENSE_ALL
    dense = cosine(vectors(texts if whole else texts.join(lexical.select("id"), "id", "left_semi")), query).filter(F.col("sim") > LEAST_COSINE)
    a = ranked(lexical.filter("score > 0"), "a", F.desc("score"), F.col("id"))
    b = ranked(dense, "b", F.desc("sim"), F.col("id"))
    both = a.join(b, "id", "full_outer").join(texts.select("id", "type", "name"), "id")
    if types:
        both = both.filter(F.col("type").isin(types))
    name, q = F.lower("name"), query.lower()
    boost = 1 + F.when(name == q, 2.5).when(name.contains(q) | F.lit(q).contains(name), 1.2).otherwise(0.0) + F.when(F.col("type").isin(FAVOURED), 0.3).otherwise(0.0)
    fused = 0.6 / (RRF_K + F.coalesce("a", F.lit(NO_RANK))) + 0.4 / (RRF_K + F.coalesce("b", F.lit(NO_RANK)))
    out = both.select("id", F.coalesce("score", F.lit(0.0)).alias("bm25"), F.coalesce("sim", F.lit(0.0)).alias("dense"), (fused * boost * 100).alias("score"))
    return out.filter(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(limit)


#: Query vectors that one pass over all vectors compares.
QUERY_BLOCK = 2000


def nearest(vectors_: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, sim, rank: the k vectors (vec_id, embedding) of the highest cosine with each query, itself left out.

    The queries are a stated set, taken in blocks of QUERY_BLOCK; each task keeps k
    rows a query, so what is shuffled does not grow with the vectors of a task. Null
    vectors are left out; a vector of zeros has a cosine of 0. Ties go by vec_id.
    """
    spark = vectors_.sparkSession
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    rows, out = [], None
    source = vectors_.select("vec_id", "embedding").filter("embedding IS NOT NULL")

    def match(block):
        known = spark.sparkContext.broadcast((np.array([r.vec_id for r in block], np.int64), unit(np.array([r.embedding for r in block], np.float64))))

        def run(batches):
            ids, q = known.value
            best: list[tuple[np.ndarray, np.ndarray]] = []
            for b in batches:
                vec = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if not len(vec):
                    continue
                sim = np.round(q @ unit(np.array(b.column(1).to_pylist(), np.float64)).T, 6)
                sim[ids[:, None] == vec[None, :]] = -np.inf
                every_id, every = np.broadcast_to(vec, sim.shape), sim
                if best:
                    every_id, every = np.concatenate((best[0][0], every_id), 1), np.concatenate((best[0][1], every), 1)
                order = np.lexsort((every_id, -every), axis=1)[:, :k]
                best = [(np.take_along_axis(every_id, order, 1), np.take_along_axis(every, order, 1))]
            if best:
                vec, sim = best[0]
                ok = np.isfinite(sim).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, vec.shape[1])[ok]), pa.array(vec.ravel()[ok]), pa.array(sim.ravel()[ok])], names=["query_id", "vec_id", "sim"])

        return source.mapInArrow(run, "query_id long, vec_id long, sim double")

    for r in queries.select("vec_id", "embedding").filter("embedding IS NOT NULL").toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            out, rows = (match(rows) if out is None else out.unionByName(match(rows))), []
    if rows:
        out = match(rows) if out is None else out.unionByName(match(rows))
    if out is None:
        return spark.createDataFrame([], "query_id long, vec_id long, sim double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)
