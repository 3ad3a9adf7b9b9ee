"""Stored indexes for retrieval: postings by term with block maxima, vectors by cell with radii; exact answers from few reads.

Both work alike.  Documents or vectors lie in blocks, and a small table bounds the score that anything in a block can have
for a query.  The best blocks are scored first; the k-th score found there is a floor, and of the other blocks only those
whose bound reaches it are read.  What is left out cannot be among the best, so answers equal a full scan.

A new index is written beside the old one and takes its place with the manifest (see `versions`).
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrace.functions import text as T
from fieldtrace.operators.retrieval import MAX_SENT, documents_terms, exploded, frequent, idf, summed, weighted
from fieldtrace.sources.tables import stage
from fieldtrace.sources.versions import Manifests

#: Folders of the postings; documents of a block; blocks that are scored first.
BUCKETS, BLOCK, FIRST = 64, 1024, 32
#: Documents whose postings of a bucket go to one task.
SLICE = 100_000
#: Vectors from which cells are learnt at most, and cells at most; every vector is indexed.
SAMPLE, CELLS = 20_000, 1024
#: Scores are rounded to four places before they are put in order: what lies so near to the floor is looked at.
NEAR = 1e-4


class Stored:
    """Tables of an index in a folder, published together."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, tables: dict[str, tuple[DataFrame | Callable[[DataFrame], DataFrame], str | None]], **facts) -> None:
        """A function makes its table from the one written before it."""
        place, before = f"{self.folder}/{uuid.uuid4().hex}", None
        for name, (df, by) in tables.items():
            df = df if isinstance(df, DataFrame) else df(self.spark.read.schema(before.schema).parquet(written))
            before, written = df, f"{place}/{name}"
            writer = df.write.partitionBy(by) if by else df.write
            writer.parquet(written)
        Manifests(self.folder).publish(lambda now: {"place": place, "facts": facts})

    def facts(self) -> dict:
        content = Manifests(self.folder).read()[1]
        if not content:
            raise FileNotFoundError(f"no index in {self.folder}")
        return content["facts"]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{Manifests(self.folder).read()[1]['place']}/{name}")


def _best(scored: DataFrame, k: int, least: float, key: str) -> DataFrame:
    """The k best rows (key, `_s`), rounded; ties by key."""
    return scored.filter(F.col("_s") >= least).select(key, F.round("_s", 4).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _floor(scored: DataFrame, k: int, least: float, key: str) -> float:
    """What a row must reach to be among the k best, as far as the scored rows tell."""
    found = [r.score for r in _best(scored, k, least, key).collect()]  # k rows
    return max(least, found[-1] - NEAR) if len(found) == k else least


# --- terms --------------------------------------------------------------------------------------------------------


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index_terms(docs: DataFrame, folder: str, doc: str = "doc_id", text: str = "text", block: int = BLOCK) -> None:
    """Stores the tf-idf weights of all terms of all documents, divided by the documents' norms, by term and block.

    Weights are dealt once, to where they are stored; norms are summed where the documents lie and joined with these, not
    with their terms.  The first posting of a term in a block is the greatest, so bounds are read off the stored postings.
    """
    spark = docs.sparkSession
    cut = stage(documents_terms(docs, doc, text), "terms")
    counts = exploded(cut)
    total = docs.count()
    weights = stage(idf(counts, F.lit(total)), "weights")
    least = frequent(weights)
    squares = lambda part: part.groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("ww"))
    norms = summed([squares(p) for p in weighted(counts, weights, least)], "ww").select("doc", F.sqrt("ww").alias("norm"))
    norms = stage(norms, "norms")
    norms = F.broadcast(norms) if norms.count() <= MAX_SENT else norms
    blocks, slices = max(1, math.ceil(total / block)), max(1, math.ceil(total / SLICE))
    normed = exploded(cut.join(norms, "doc"))
    placed = functools.reduce(DataFrame.unionByName, weighted(normed, weights, least))
    placed = placed.select(_bucket(F.col("term")).alias("bucket"), "term", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int").alias("block"), "doc", (F.col("w") / F.col("norm")).alias("w"))
    # A frequent term spans several files: those of a bucket are dealt by slices of its blocks.
    dealt = ["bucket", "slice"]
    placed = placed.withColumn("slice", F.pmod("block", F.lit(slices))).repartition(*dealt)
    place = Window.partitionBy(*dealt, "term", "block").orderBy(F.desc("w"), "doc")
    placed = placed.withColumn("top", F.row_number().over(place) == 1).drop("slice")
    bounds = lambda written: written.filter("top").select("bucket", "term", "block", F.col("w").alias("most"))
    terms = weights.select(_bucket(F.col("term")).alias("bucket"), "term", "idf").repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term")
    Stored(spark, folder).save({"postings": (placed, "bucket"), "bounds": (bounds, "bucket"), "terms": (terms, "bucket")}, documents=total, blocks=blocks)


def search_terms(spark: SparkSession, folder: str, query: str, k: int = 5, least: float = 0.1) -> DataFrame:
    """(doc, score): as `retrieval.tfidf_topk` over the indexed documents, from the postings of the query's terms alone."""
    index = Stored(spark, folder)
    index.facts()
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(T.tokens(F.col("q"))).alias("term")).groupBy("term").count()
    asked = {r["term"]: (r["count"], r["bucket"]) for r in asked.withColumn("bucket", _bucket(F.col("term"))).collect()}  # terms of one query
    if not asked:
        return spark.createDataFrame([], "doc string, score double")
    mine = F.col("bucket").isin(sorted({b for _, b in asked.values()})) & F.col("term").isin(sorted(asked))
    known = {r.term: r.idf for r in index.read("terms").filter(mine).select("term", "idf").collect()}
    total = sum(n for n, _ in asked.values())
    weight = {t: n / total * known.get(t, 1.0) for t, (n, _) in asked.items()}
    length = math.sqrt(sum(q * q for q in weight.values()))
    share = F.element_at(F.create_map(*(F.lit(x) for t in sorted(weight) for x in (t, weight[t] / length))), F.col("term"))
    bounds = index.read("bounds").filter(mine).groupBy("block").agg(F.sum(share * F.col("most")).alias("bound"))
    bounds = stage(bounds.filter(F.col("bound") >= least - NEAR), "bounds")
    postings = index.read("postings").filter(mine)
    score = lambda rows: rows.groupBy("doc").agg(F.sum(share * F.col("w")).alias("_s"))
    first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
    floor = _floor(score(postings.filter(F.col("block").isin(first))), k, least, "doc")
    reached = bounds.filter(F.col("bound") >= floor - NEAR).select("block")
    return _best(score(postings.join(reached, "block", "left_semi")), k, least, "doc")


# --- vectors ------------------------------------------------------------------------------------------------------


def _unit(v: Column) -> Column:
    p = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(p, F.lit(0.0), lambda s, x: s + x * x))
    fit = p.isNotNull() & (norm > 0) & (norm < float("inf")) & ~F.exists(p, lambda x: x.isNull())
    return F.when(fit, F.transform(p, lambda x: x / norm))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def index_vectors(vectors: DataFrame, folder: str, key: str = "vec_id", column: str = "embedding", cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> None:
    """Stores all vectors by cell, with each cell's centre and the widest angle from it.

    Centres are learnt from at most `sample` vectors; which these are changes what is read, not what is found.  Vectors
    without a direction have a cell of their own.
    """
    spark = vectors.sparkSession
    own = stage(vectors.select(F.col(key).alias("key"), F.col(column).alias("vector"), _unit(F.col(column)).alias("unit")), "vectors")
    good = own.filter("unit is not null")
    n = good.count()
    wide = good.select(F.size("unit").alias("d")).distinct().limit(2).collect()
    if len(wide) > 1:
        raise ValueError("vectors differ in length")
    wanted = max(1, min(CELLS, cells or math.isqrt(n) or 1))
    learnt = good.orderBy(F.xxhash64("key", F.lit(seed))).limit(sample).select(array_to_vector("unit").alias("features"))
    if n:
        model = KMeans(k=max(2, wanted), seed=seed, maxIter=10, distanceMeasure="cosine").fit(learnt)
        centres = [[float(x) for x in c] for c in model.clusterCenters()]
        centres = [[x / math.hypot(*c) for x in c] for c in centres if math.hypot(*c) > 0]
        assigned = _assign(good, centres)
    else:
        centres, assigned = [], good.select("key", "vector", F.lit(-1).alias("cell"), F.lit(0.0).alias("angle"))
    rest = own.filter("unit is null").select("key", "vector", F.lit(-1).alias("cell"), F.lit(0.0).alias("angle"))
    placed = stage(assigned.unionByName(rest).repartitionByRange("cell", "key").sortWithinPartitions("cell", "key"), "cells")
    radii = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("held"))
    kind = "cell int, centre array<double>"
    middle = spark.createDataFrame(list(enumerate(centres)), kind)  # CELLS rows at most
    Stored(spark, folder).save({"vectors": (placed.drop("angle"), "cell"), "cells": (radii.join(F.broadcast(middle), "cell", "left"), None)}, vectors=n)


def _assign(good: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Each vector's nearest centre and the angle to it."""
    kind = "array<struct<cell:int,centre:array<double>>>"
    held = good.sparkSession.createDataFrame([(list(enumerate(centres)),)], f"centres {kind}")  # CELLS rows at most
    near = F.aggregate("centres", F.struct(F.lit(-2.0).alias("c"), F.lit(-1).alias("cell")), lambda s, x: F.greatest(s, F.struct(_dot(F.col("unit"), x["centre"]).alias("c"), x["cell"].alias("cell"))))
    found = good.crossJoin(F.broadcast(held)).withColumn("near", near)  # one row
    return found.select("key", "vector", F.col("near.cell").alias("cell"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("near.c")))).alias("angle"))


def search_vectors(spark: SparkSession, folder: str, query: list[float], k: int = 5, least: float = 0.3) -> DataFrame:
    """(key, score): as `retrieval.cosine_topk` over the indexed vectors, from the cells that can hold the best."""
    index = Stored(spark, folder)
    index.facts()
    length = math.sqrt(sum(x * x for x in query))
    asked = F.array(*(F.lit(float(x) / length if length else 0.0) for x in query))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(F.col("centre"), asked))))
    # A millionth is left for rounding; vectors without a direction score 0.
    bound = F.when(F.col("centre").isNull() | F.lit(not length), 0.0).otherwise(F.cos(F.greatest(angle - F.col("radius") - 1e-6, F.lit(0.0))))
    cells = sorted(((r.bound, r.cell) for r in index.read("cells").select(bound.alias("bound"), "cell").collect()), reverse=True)  # CELLS rows at most
    vectors = index.read("vectors")
    score = lambda chosen: vectors.filter(F.col("cell").isin(chosen)).select("key", T.cosine(F.col("vector"), F.array(*(F.lit(float(x)) for x in query))).alias("_s"))
    floor = _floor(score([c for _, c in cells[:4]]), k, least, "key")
    return _best(score([c for b, c in cells if b >= floor - NEAR]), k, least, "key")
