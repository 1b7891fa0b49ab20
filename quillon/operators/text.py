"""Full-text search: tokens, postings, BM25 and n-gram substring search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.runtime import cut

K1, B = 1.2, 0.75
CJK = r"[一-鿿㐀-䶿豈-﫿぀-ヿ가-힯]"


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters, digits and _; every CJK character; and pairs of neighbouring CJK characters
    in the text's CJK characters alone. Null text has no tokens."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.coalesce(t, F.lit(""))
    words = F.transform(F.regexp_extract_all(t, F.lit("([A-Za-z0-9_]+)"), F.lit(1)), F.lower)
    chars = F.regexp_extract_all(t, F.lit(f"({CJK})"), F.lit(1))
    pairs = F.when(F.size(chars) > 1, F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, chars, pairs)


def ngrams(text: Column | str, n: int = 2) -> Column:
    """Character n-grams; a value shorter than n stands for itself."""
    t = F.col(text) if isinstance(text, str) else text
    chars = F.filter(F.split(t, ""), lambda c: c != "")

    def grams(cs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(cs) - n, F.lit(0))), lambda i: F.concat(*[F.coalesce(F.get(cs, i + k), F.lit("")) for k in range(n)]))

    # the array of one array binds the characters to a name; written out, they would be split again for every n-gram
    return F.when(F.length(t) < n, F.array(t)).otherwise(F.get(F.transform(F.array(chars), grams), F.lit(0)))


def postings(docs: DataFrame, doc_id: str, fields: list[str]) -> DataFrame:
    """(term, doc, field, tf): counts of each term per document and field."""
    parts = None
    for f in fields:
        p = docs.select(F.col(doc_id).alias("doc"), F.lit(f).alias("field"), F.explode(tokens(f)).alias("term"))
        parts = p if parts is None else parts.union(p)
    return parts.groupBy("term", "doc", "field").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, doc_id: str, fields: list[str], query: str, k: int | None = None) -> DataFrame:
    """(doc, score, fields), best first: BM25 with k1 = 1.2 and b = 0.75.

    A document's length is its tokens over all fields; a term's document frequency counts (document, field)
    postings; a token that stands twice in the query counts twice. Only postings of query terms leave a document's
    row, which carries its length along, so what is shuffled follows the hits.
    """
    spark = docs.sparkSession
    terms = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    words = [r["term"] for r in terms.collect()]  # the query's own tokens

    def hits(f: str, i: int) -> Column:
        return F.transform(F.filter(f"t{i}", lambda x: x.isin(words)), lambda x: F.struct(F.lit(f).alias("field"), x.alias("term")))

    # one pass over the texts; what is kept is a length and the hits of each document
    split = docs.select(F.col(doc_id).alias("doc"), *(tokens(f).alias(f"t{i}") for i, f in enumerate(fields)))
    kept = cut(split.select("doc", sum((F.size(f"t{i}") for i in range(len(fields))), F.lit(0)).alias("len"), F.concat(*(hits(f, i) for i, f in enumerate(fields))).alias("hs")))
    stats = kept.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    hit = kept.select("doc", "len", F.explode("hs").alias("h"))
    hit = hit.groupBy("h.term", "doc", "h.field", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = hit.join(F.broadcast(df), "term").join(F.broadcast(terms), "term").crossJoin(F.broadcast(stats))  # one row per query term, and one
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))) * F.col("times")
    out = x.groupBy("doc").agg(F.sum(part).alias("score"), F.sort_array(F.collect_set("field")).alias("fields")).orderBy(F.desc("score"), "doc")
    return out if k is None else out.limit(k)


def substring_search(docs: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows whose text contains the needle (case matters), without an index: one scan, evaluated in the JVM."""
    return docs.where(F.contains(F.col(column), F.lit(needle)))


def gram_index(docs: DataFrame, key: str, column: str, n: int = 2) -> DataFrame:
    """(gram, key): distinct n-gram postings, to be written partitioned or bucketed by gram for repeated use."""
    return docs.where(F.col(column).isNotNull()).select(F.col(key), F.explode(F.array_distinct(ngrams(column, n))).alias("gram"))


def indexed_search(index: DataFrame, docs: DataFrame, key: str, column: str, needle: str, n: int = 2) -> DataFrame:
    """Rows that contain the needle: candidates have all its n-grams, then the text is verified. A shorter needle scans."""
    if len(needle) < n:
        return substring_search(docs, column, needle)
    grams = sorted({needle[i : i + n] for i in range(len(needle) - n + 1)})
    cand = index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == len(grams)).select(key)
    return substring_search(docs.join(cand, key, "left_semi"), column, needle)
