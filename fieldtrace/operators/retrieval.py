"""Term and vector retrieval."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions import text as T
from fieldtrace.sources.tables import stage


#: Terms whose weights are sent to every task, the most frequent ones; pairs with others are joined by shuffle.
MAX_SENT = 300_000


def documents_terms(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, total, terms): the number of a document's tokens, and its distinct terms with their counts.

    Counted in the document's own row, without a shuffle.  Rows that share a document and a total count as one: where any
    document has several rows, they are summed, and each term has a row of its own.
    """
    own = docs.select(F.col(doc).alias("doc"), _counted(T.tokens(F.col(text))).alias("_c"))
    out = own.select("doc", "_c.total", "_c.terms")
    if docs.groupBy(doc).count().filter("count > 1").isEmpty():
        return out
    summed = exploded(out).groupBy("doc", "term", "total").agg(F.sum("count").alias("count"))
    return summed.select("doc", "total", F.array(F.struct("term", "count")).alias("terms"))


def _counted(tokens: Column) -> Column:
    """(total, terms) of a row's tokens; both are empty without any.

    The tokens are bound to a lambda's variable: Spark copies an expression into filters below it, and a column read in a
    lambda would there be cut from its text anew for each of its tokens.
    """
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    # Tokens in order: a term's count is the distance from its first place to the next term's.
    changes = lambda t: lambda i: (i <= F.size(t)) & ((i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
    first = lambda t: F.filter(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), changes(t))
    one = lambda t, at: lambda i, k: F.struct(F.get(t, i - 1).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t) + 1) - i).cast("long").alias("count"))
    terms = lambda t: bound(first(t), lambda at: F.transform(at, one(t, at)))
    return bound(F.sort_array(F.coalesce(tokens, F.array().cast("array<string>"))), lambda t: F.struct(F.size(t).alias("total"), terms(t).alias("terms")))


def exploded(terms: DataFrame) -> DataFrame:
    """(doc, term, count, total and further columns) of the rows of `documents_terms`."""
    more = [c for c in terms.columns if c not in ("doc", "total", "terms")]
    # Rows without terms go afterwards: Spark would ask for the size of lists before they are exploded, and so make them twice.
    each = terms.select("doc", "total", *more, F.explode_outer("terms").alias("_x")).filter("_x is not null")
    return each.select("doc", "_x.term", "_x.count", "total", *more)


def term_counts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, count, total) of every document."""
    return exploded(documents_terms(docs, doc, text))


def idf(counts: DataFrame, documents: Column) -> DataFrame:
    """(term, df, idf) with idf = ln((N + 1) / (df + 1)) + 1."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((documents + 1) / (F.col("df") + 1)) + 1)


def frequent(weights: DataFrame, most: int | None = None) -> int:
    """The least df of which, and of all above, there are at most so many terms; 1 if all terms are so few."""
    left, cut = MAX_SENT if most is None else most, None
    # Classes of an eighth of a power of two; one row each.
    classes = weights.groupBy(F.floor(F.log2("df") * 8).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.min("df").alias("low"), F.max("df").alias("high")).orderBy(F.desc("class")).collect()
    for r in classes:
        if r.n > left:
            return cut or r.high + 1
        left, cut = left - r.n, r.low
    return 1


def weighted(counts: DataFrame, weights: DataFrame, cut: int) -> list[DataFrame]:
    """(doc, term, w and further columns of `counts`) in parts: terms of df `cut` and more without a shuffle, the rest by one."""
    more = [c for c in counts.columns if c not in ("doc", "term", "count", "total")]
    sent = F.broadcast(weights.filter(F.col("df") >= cut).select("term", "idf"))
    rest = [] if cut <= 1 else [counts.join(sent, "term", "left_anti").join(weights.filter(F.col("df") < cut).select("term", "idf"), "term")]
    return [p.select("doc", "term", (F.col("count") / F.col("total") * F.col("idf")).alias("w"), *more) for p in [counts.join(sent, "term"), *rest]]


def tfidf_topk(docs: DataFrame, query: str, k: int = 5, least: float = 0.1, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The k documents nearest to a query by cosine of tf-idf weights; ties by document.

    Terms that no document has weigh with idf 1 in the query's norm.  Norms of documents need all their terms: those of the
    frequent ones are summed where the document lies, and only pairs with rare terms are dealt by term.
    """
    spark = docs.sparkSession
    # Written once: texts are cut into terms in one pass, which the weights and the norms then read.
    terms = stage(documents_terms(docs, doc, text), "terms")
    counts = exploded(terms)
    weights = stage(idf(counts, F.lit(docs.count())), "weights")
    asked = spark.createDataFrame([(query,)], "q string").select(T.tokens(F.col("q")).alias("_t"))
    asked = asked.select(F.size("_t").alias("total"), F.explode("_t").alias("term")).groupBy("term", "total").agg(F.count(F.lit(1)).alias("count"))
    # One query's terms look their weights up; these are not dealt for it.
    asked = F.broadcast(asked)
    known = weights.join(asked.select("term"), "term", "left_semi").select("term", "idf")
    asked = asked.join(F.broadcast(known), "term", "left").select("term", (F.col("count") / F.col("total") * F.coalesce("idf", F.lit(1.0))).alias("q"))
    squares = lambda part: part.join(F.broadcast(asked), "term", "left").groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("ww"), F.sum(F.col("w") * F.col("q")).alias("wq"))
    norms = summed([squares(p) for p in weighted(counts, weights, frequent(weights))], "ww", "wq")
    length = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    scored = norms.filter("wq is not null").crossJoin(F.broadcast(length)).withColumn("_s", F.col("wq") / (F.sqrt("ww") * F.col("qn")))  # one row
    return scored.filter(F.col("_s") >= least).select("doc", F.round("_s", 4).alias("score")).orderBy(F.desc("score"), "doc").limit(k)


def summed(parts: list[DataFrame], *names: str) -> DataFrame:
    """Sums by document over the parts of `weighted`."""
    if len(parts) == 1:
        return parts[0]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("doc").agg(*(F.sum(c).alias(c) for c in names))


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 5, least: float = 0.3, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k vectors nearest to a query; ties by key."""
    scored = vectors.withColumn("_s", T.cosine(F.col(column), F.array(*map(F.lit, query))))
    return scored.filter(F.col("_s") >= least).select(key, F.round("_s", 4).alias("score")).orderBy(F.desc("score"), key).limit(k)


def tickets(table: DataFrame, task: str, words: list[str], exact: int = 5, fuzzy: int = 3) -> DataFrame:
    """Tickets whose key the task names, then those that hold a word; in table order within both (`seq`)."""
    task_ids = T.ticket_ids(F.lit(task))
    named = table.filter(F.array_contains(task_ids, F.col("key"))).orderBy("seq").limit(exact).withColumn("rank", F.lit(0))
    text = F.lower(F.concat_ws(" ", "summary", "description", "resolution"))
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w.lower())
    rest = table.filter(~F.array_contains(task_ids, F.col("key")) & hit).orderBy("seq").limit(fuzzy).withColumn("rank", F.lit(1))
    return named.unionByName(rest).orderBy("rank", "seq")


def chunk_table(docs: DataFrame, chunks: Column, doc: str) -> DataFrame:
    """One row per chunk: id, place and text."""
    each = docs.select(F.col(doc).alias("doc"), F.posexplode(chunks).alias("idx", "c"))
    return each.select("doc", "idx", F.concat_ws("_", F.col("doc").cast("string"), F.col("idx").cast("string")).alias("chunk_id"), "c.text", "c.start", "c.stop")
