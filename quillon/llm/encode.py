"""Token ids of a corpus under a public tokenizer.

The vocabulary is read once on the driver (tokenizer_dir is a parameter) and broadcast, some 1 MB of a fixed file.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.runtime import spread

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the published pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the vocabularies that are split by this pattern.
BYTE_LEVEL = ("byte_bpe_50k", "byte_bpe_multi_50k")
CHUNK = 32_768
OVERLAP = 1_024


class Tokenizer:
    """Byte-level BPE from a rank file, built once in every Python worker. Vocabularies of another kind raise."""

    def __init__(self, spark: SparkSession, name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR):
        if name not in BYTE_LEVEL:
            raise ValueError(f"{name} isn't split by the pattern known here; known: {', '.join(BYTE_LEVEL)}")
        with open(os.path.join(tokenizer_dir, f"{name}.tiktoken"), "rb") as f:
            self.name, self.ranks = name, spark.sparkContext.broadcast(f.read())

    def ranks_of(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.value.splitlines())}

    def get(self):
        import tiktoken
        import tiktoken.registry as kept  # outlives the task in the worker

        key = f"quillon-{self.name}"
        if key not in kept.ENCODINGS:
            kept.ENCODINGS[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=self.ranks_of(), special_tokens={})
        return kept.ENCODINGS[key]


def _encode(tok: Tokenizer):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = tok.get()
        for s in parts:
            yield pd.Series([enc.encode_ordinary(x) if x else [] for x in s], dtype=object)

    return encode


def _count(tok: Tokenizer):
    @F.pandas_udf(T.LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = tok.get()
        for s in parts:
            yield pd.Series([len(enc.encode_ordinary(x)) if x else 0 for x in s], dtype="int64")

    return count


def edge_boundaries(text: str, start: int, first: bool, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Where pre-tokens begin in the first and in the last `overlap` characters of a chunk, as places in the document.

    The chunk's last two pre-tokens are left out, as the text that follows could still change them. In the last
    characters places after white space are left out too: where a piece ends in a run of blanks, the pattern takes
    the run as a whole, but leaves its last blank apart where text follows.
    """
    import regex

    begins = [m.start() for m in regex.compile(PATTERN).finditer(text)]
    left = [] if first else [start + b for b in begins if b <= overlap]
    return left, [start + b for b in begins[:-2] if b >= chunk and not text[b - 1].isspace()]


def stitch(edges: list[tuple[list[int], list[int]]]) -> list[int]:
    """Cuts between neighbouring chunks: the first boundary on which the pre-tokens of both agree.

    From such a place on, both chunks split the text alike, as the pattern only looks ahead; and the piece before
    it is split as in the whole text, as no blank is its last character (see edge_boundaries). Once two neighbours
    don't agree anywhere in their overlap, nothing later is known to be split rightly, and the rest of the
    document stays one piece.
    """
    cuts = []
    for (_, right), (left, _) in zip(edges, edges[1:]):
        shared = sorted(set(right) & set(left))
        if not shared:
            break
        cuts.append(shared[0])
    return cuts


def text_pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc, no, piece): texts as pieces that can be encoded on their own; a text of up to `chunk` characters is one piece.

    Longer texts are cut into overlapping chunks, spread over the cluster, pre-tokenised there, and cut again
    where the pre-tokens of neighbouring chunks agree. Only the boundaries near chunk edges are brought together.
    """
    d = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t"))
    short = d.where(f"t is null or length(t) <= {chunk}").select("doc", F.lit(0).alias("no"), F.col("t").alias("piece"))
    long = d.where(f"length(t) > {chunk}").withColumn("len", F.length("t"))
    starts = F.sequence(F.lit(0), F.col("len") - 1, F.lit(chunk))
    chunks = long.select("doc", F.explode(starts).alias("start"), "t").select("doc", "start", F.substring("t", F.col("start") + 1, F.lit(chunk + overlap)).alias("part")).repartition("doc", "start")

    @F.pandas_udf("struct<l: array<int>, r: array<int>>")
    def edges(starts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        found = [edge_boundaries(p, int(s), s == 0, chunk, overlap) for s, p in zip(starts, parts)]
        return pd.DataFrame({"l": [x[0] for x in found], "r": [x[1] for x in found]})

    @F.pandas_udf("array<int>")
    def cuts(rows: pd.Series) -> pd.Series:
        return pd.Series([stitch([(list(e["e"]["l"]), list(e["e"]["r"])) for e in sorted(es, key=lambda e: e["start"])]) for es in rows], dtype=object)

    found = chunks.select("doc", "start", edges("start", "part").alias("e")).groupBy("doc").agg(F.collect_list(F.struct("start", "e")).alias("es"))
    found = found.select("doc", cuts("es").alias("cuts"))
    whole = long.join(found, "doc").select("doc", "t", F.concat(F.array(F.lit(0)), "cuts").alias("from"), F.concat("cuts", F.array("len")).alias("to"))
    cut = whole.select("doc", "t", F.posexplode(F.arrays_zip("from", "to")).alias("no", "x"))
    cut = cut.select("doc", "no", F.substring("t", F.col("x.from") + 1, F.col("x.to") - F.col("x.from")).alias("piece")).repartition("doc", "no")
    return short.union(cut)


def token_ids(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): the token ids of every text, without special tokens; one row per document.

    Null and empty texts have no ids (an empty list); the strings of special tokens are ordinary text. doc_id
    must be unique. Short texts are encoded where they lie; only texts longer than `chunk` characters are cut
    (see text_pieces), encoded in parallel and put together again. An empty table gives no rows; other columns
    are ignored.
    """
    enc = _encode(Tokenizer(docs.sparkSession, tokenizer, tokenizer_dir))
    docs = spread(docs.select(doc_id, text), doc_id)
    cond = f"{text} is null or length({text}) <= {chunk}"
    short = docs.where(cond).select(F.col(doc_id).alias("doc_id"), enc(F.coalesce(text, F.lit(""))).alias("ids"))
    long = text_pieces(docs.where(f"length({text}) > {chunk}"), doc_id=doc_id, text=text, chunk=chunk, overlap=overlap)
    long = long.select("doc", "no", enc("piece").alias("ids")).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("ps"))
    return short.union(long.select("doc", F.flatten("ps.ids")))


def token_counts(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, the columns `keep`, tokens): the number of token ids of every text; rules as in token_ids."""
    count = _count(Tokenizer(docs.sparkSession, tokenizer, tokenizer_dir))
    docs = spread(docs.select(doc_id, text, *keep), doc_id)
    short = docs.where(f"{text} is null or length({text}) <= {chunk}").select(F.col(doc_id).alias("doc_id"), *keep, count(F.coalesce(text, F.lit(""))).alias("tokens"))
    long = docs.where(f"length({text}) > {chunk}")
    pieces = text_pieces(long, doc_id=doc_id, text=text, chunk=chunk, overlap=overlap)
    sums = pieces.select(F.col("doc").alias("doc_id"), count("piece").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("tokens"))
    if keep:
        sums = sums.join(long.select(F.col(doc_id).alias("doc_id"), *keep), "doc_id")
    return short.union(sums.select("doc_id", *keep, "tokens"))


def decoded(encoded: DataFrame, *, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, text): ids back to text by concatenating the raw bytes of the tokens; invalid UTF-8 becomes U+FFFD."""
    tok = Tokenizer(encoded.sparkSession, tokenizer, tokenizer_dir)

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        raw = {v: k for k, v in tok.ranks_of().items()}
        for s in parts:
            yield pd.Series([None if x is None else b"".join(raw[int(i)] for i in x).decode("utf-8", "replace") for x in s], dtype=object)

    return encoded.select("doc_id", decode("ids").alias("text"))
