"""Packing documents into bins of a fixed token capacity by harmonic classes.

A document longer than the capacity gives whole pieces of that length and a
rest. A piece of n tokens is of class min(capacity // n, classes): pieces whose
length lies in (capacity / (j + 1), capacity / j] form class j, of which exactly
j fit into a bin. Every bin of class j takes j pieces; no other fit is looked
for, so workers fill bins without knowing of each other. A worker is a shard of
the documents, chosen by a hash of doc_id, which makes the bins the same on any
cluster; there is one for each SHARD_ROWS rows of the table. Only the last bin
of a class and shard may hold fewer pieces.

A document that the table has several times (epochs of a mixture) is packed as
often, but never twice into one bin: its n-th appearance goes to the bins of
round n.

Tokens are runs of characters other than blank, tab and line ends.

Defined cases: a null or empty text gives no piece; where doc_id is null, the
MD5 of the text stands for it; repeated rows are packed each, in rounds of their
own; so are different texts of one doc_id, as far as they have pieces of the
same start and class; ties are in the order of doc_id, then of the piece's
start; an empty table gives no bins; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import TOKEN, n_tokens, seeded_hash

CAPACITY = 2048
CLASSES = 64
#: Rows of the table for each shard.
SHARD_ROWS = 65_536
SEED = 7


def pack(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, shard_rows: int = SHARD_ROWS, with_text: bool = False) -> DataFrame:
    """One row a piece: shard, class, round, bin (its number in these), slot, doc_id, start and n_tokens; with its text if wanted."""
    shards = max(1, -(-docs.count() // shard_rows))
    cap = F.lit(capacity).cast("bigint")
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))).alias("_key")
    rows = docs.select("doc_id", key, *(["text"] if with_text else []), n_tokens().alias("n")).where("n > 0")
    numbers = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {capacity}"))
    if with_text:
        # a long text is cut into tokens once, and its pieces leave without the rest
        cut = lambda tokens: F.transform(numbers, lambda i: F.struct(i.alias("i"), F.array_join(F.slice(tokens, (i * capacity + 1).cast("int"), F.lit(capacity)), "").alias("text")))
        tokens = F.regexp_extract_all("text", F.lit("[ \\t\\r\\n]*" + TOKEN), F.lit(0))
        whole = F.array(F.struct(F.lit(0).cast("bigint").alias("i"), F.col("text").alias("text")))
        pieces = F.when(F.col("n") > capacity, F.get(F.transform(F.array(tokens), cut), F.lit(0))).otherwise(whole)
    else:
        pieces = F.transform(numbers, lambda i: F.struct(i.alias("i")))
    rows = rows.select("doc_id", "_key", "n", F.explode(pieces).alias("p")).select("doc_id", "_key", "n", "p.*")
    rows = rows.withColumns({"start": F.col("i") * capacity, "n_tokens": F.least(cap, F.col("n") - F.col("i") * capacity)})
    rows = rows.withColumns({
        "class": F.least(F.lit(classes).cast("bigint"), F.lit(capacity).cast("bigint") / F.col("n_tokens")).cast("int"),
        "shard": (seeded_hash(SEED, F.lit(0), "_key") % shards).cast("int"),
    })
    # both windows work within the partitions of this one exchange
    rows = rows.repartition("shard", "class")
    again = F.row_number().over(Window.partitionBy("shard", "class", "_key", "start").orderBy("n_tokens", *(["text"] if with_text else []))) - 1
    place = F.row_number().over(Window.partitionBy("shard", "class", "round").orderBy("doc_id", "_key", "start")) - 1
    rows = rows.withColumn("round", again).withColumn("k", place).withColumns({"bin": F.expr("k div class"), "slot": (F.col("k") % F.col("class")).cast("int")})
    return rows.select("shard", "class", "round", "bin", "slot", "doc_id", "start", "n_tokens", *(["text"] if with_text else []))


def oracle(capacity: int = CAPACITY, classes: int = CLASSES, shard_rows: int = SHARD_ROWS) -> str:
    return f"""with d as (select doc_id, coalesce(doc_id::varchar, md5(text)) key, len(regexp_extract_all(text, '[^ \\t\\r\\n]+'))::bigint n from documents),
  p as (select doc_id, key, unnest(range(0, n, {capacity})) as start, n from d where n > 0),
  q as (select doc_id, key, start, least({capacity}, n - start) as n_tokens from p),
  c as (select *, least({classes}, {capacity} // n_tokens)::int as class, (('0x' || substr(md5('{SEED}:0:' || key), 1, 15))::bigint % (select greatest(1, (count(*) + {shard_rows - 1}) // {shard_rows}) from documents))::int as shard from q),
  r as (select *, (row_number() over (partition by shard, class, key, start order by n_tokens) - 1)::int as round from c),
  k as (select *, row_number() over (partition by shard, class, round order by doc_id nulls first, key, start) - 1 as k from r)
select shard, class, round, k // class as bin, (k % class)::int as slot, doc_id, start, n_tokens from k"""
