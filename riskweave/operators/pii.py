"""Detection of personal data in three modes, as DataFrame plans.

``line``   each line by itself; of a value that repeats in a document, whatever
           its family, the first occurrence counts (family, line, position);
``block``  the whole text at once; a value belongs to the earliest family that
           has it, and its repeats within that family all count;
``cell``   one value of a table at a time; the first family whose pattern occurs
           and whose validator accepts the entire cell.

Texts first pass through Arrow, where RE2 tells by the patterns' loose forms which of them can occur at all. It reads a text once for all
of them; nearly all texts end there. What is found, is found by the patterns themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.patterns import GATES, IDENTIFIERS, LOOSE, PATTERNS, PatternSpec
from ..functions.validators import VALIDATORS

PREVIEWS = 10
_MATCH = "array<struct<type_ord:int,pos:int,value:string>>"


def normalise(v: Column) -> Column:
    return F.upper(F.replace(v, F.lit(" "), F.lit("")))


def preview(v: Column) -> Column:
    return F.when(F.length(v) > 4, F.concat(F.substring(v, 1, 4), F.lit("..."))).otherwise(v)


def _gate(name: str, text: Column) -> Column:
    """Whether a text can match any pattern of the gate; patterns are tried only where it holds."""
    return F.contains(text, F.lit(GATES[name])) if name in "@=" else text.rlike(GATES[name])


def _found(text: Column, p: PatternSpec, order: int, group: int) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(p.regex), F.lit(group)), lambda v, i: F.struct(F.lit(order).alias("type_ord"), i.alias("pos"), v.alias("value")))


def _bits(order: list[int]) -> int:
    return sum(1 << i for i in order)


def _can(can: Column, *order: int) -> Column:
    """Whether any of the patterns can occur."""
    return can.bitwiseAND(F.lit(_bits(list(order)))) != 0


def _search(use: list[int]) -> Callable:
    """A function of Arrow strings without nulls for the tasks: the places of those in which any of the patterns can occur, and a bit for each of these patterns."""
    loose = [(i, LOOSE[i]) for i in use]

    def search(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # as bytes: no text is invalid, and RE2 counts each as a character
        texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        some = pc.match_substring_regex(texts, "|".join(f"(?:{x})" for _, x in loose))
        at, texts = pc.indices_nonzero(some), texts.filter(some)
        can = np.zeros(len(texts), np.int32)
        for i, x in loose if len(texts) else ():
            can |= pc.match_substring_regex(texts, x).to_numpy(zero_copy_only=False).astype(np.int32) << i
        return at, pa.array(can, pa.int32())

    return search


def _candidates(rows: DataFrame, use: list[int]) -> DataFrame:
    """The rows whose ``_text`` can have a match, with ``_can``, the bits of the patterns."""
    search = _search(use)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            at, can = search(batch.column("_text"))
            if len(at):
                batch = batch.take(at)
                yield pa.RecordBatch.from_arrays([*batch.columns, can], names=[*batch.schema.names, "_can"])

    return rows.mapInArrow(keep, StructType([*rows.schema.fields, StructField("_can", IntegerType())]))


def _hits(text: Column, can: Column, use: list[tuple[int, PatternSpec]], mode: str) -> Column:
    """All matches of a text, gate by gate, by the patterns that can occur."""
    parts, none = [], F.array().cast(_MATCH)
    for gate in GATES:
        own = [(i, F.when(_can(can, i), _found(text, p, i, p.group if mode == "block" else 0)).otherwise(none)) for i, p in use if p.gate == gate]
        if own:
            parts.append(F.when(_can(can, *[i for i, _ in own]) & _gate(gate, text), F.flatten(F.array(*[x for _, x in own]))).otherwise(none))
    return F.concat(*parts)


def _valid(order: Column, value: Column) -> Column:
    """One branch a family with a validator; families without one are always valid."""
    test = F.lit(True)
    for i, p in enumerate(PATTERNS):
        if p.validator:
            test = F.when(order == i, VALIDATORS[p.validator](value)).otherwise(test)
    return test


def _names(order: Column) -> Column:
    # get, not element_at: that counts as never null, so a filter on null names would be dropped
    return F.get(F.array(*[F.lit(p.name) for p in PATTERNS]), order)


def spread(rows: DataFrame) -> DataFrame:
    """Deals out the rows of files that are fewer than the cores and too small to be read in parts; the search costs far more than that. It looks at the plan alone and starts no job."""
    spark = rows.sparkSession
    if rows.isStreaming:
        return rows
    cores, files = spark.sparkContext.defaultParallelism, len(rows.inputFiles())
    part = rows.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(4 * cores) if 0 < files < cores and size < cores * part else rows


def raw_matches(docs: DataFrame, key: str, text: str, mode: str = "line", patterns: list[str] | None = None) -> DataFrame:
    """Each valid match: key, line, type_ord, type, pos, value, norm."""
    use = [(i, p) for i, p in enumerate(PATTERNS) if patterns is None or p.name in patterns]
    rows = _candidates(spread(docs.select(F.col(key), F.col(text).alias("_text")).where("_text is not null")), [i for i, _ in use])
    # the outer forms keep the optimiser from adding a filter that searches every text once more
    if mode == "line":
        rows = rows.select(key, "_can", F.posexplode_outer(F.split("_text", "\n")).alias("line", "_text")).where("_text != ''")
    else:
        rows = rows.withColumn("line", F.lit(0))
    rows = rows.select(key, "line", F.explode_outer(_hits(F.col("_text"), F.col("_can"), use, mode)).alias("m")).where("m is not null").select(key, "line", "m.*")
    rows = rows.where(_valid(F.col("type_ord"), F.col("value")))
    return rows.select(key, "line", "type_ord", _names(F.col("type_ord")).alias("type"), "pos", "value", normalise(F.col("value")).alias("norm"))


def matches(docs: DataFrame, key: str, text: str, mode: str = "line") -> DataFrame:
    """The matches that count in the mode, after values are given to families."""
    rows = raw_matches(docs, key, text, mode)
    if mode == "line":
        first = Window.partitionBy(key, "norm").orderBy("type_ord", "line", "pos")
        return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    owner = F.min("type_ord").over(Window.partitionBy(key, "norm"))
    return rows.withColumn("_o", owner).where("type_ord = _o").drop("_o")


def per_document(found: DataFrame, key: str) -> DataFrame:
    """key, pii_types (sorted), pii_count and data_subjects of each document with a match."""
    subject = F.when(F.col("type").isin(*IDENTIFIERS), F.col("norm"))
    return found.groupBy(key).agg(F.array_sort(F.collect_set("type")).alias("pii_types"), F.count("*").alias("pii_count"), F.count_distinct(subject).alias("data_subjects"))


def by_type(found: DataFrame, key: str) -> DataFrame:
    """type, documents that have it, matches, and distinct values in each document (summed)."""
    each = found.groupBy("type", key).agg(F.count("*").alias("n"), F.count_distinct("norm").alias("d"))
    return each.groupBy("type").agg(F.count("*").alias("documents"), F.sum("n").alias("matches"), F.sum("d").alias("distinct_values"))


def previews(found: DataFrame, key: str, most: int = PREVIEWS) -> DataFrame:
    """The first matches of each family in each document, masked."""
    place = F.row_number().over(Window.partitionBy(key, "type").orderBy("line", "pos"))
    return found.withColumn("place", place).where(F.col("place") <= most).select(key, "type", "place", (F.col("line") + 1).alias("line_number"), preview(F.col("value")).alias("value_preview"))


def cell_type(value: Column, can: Column) -> Column:
    """Mode cell: the family of one cell, or null; of several the earliest. Only patterns that can occur are tried, and none after a hit."""
    own = []
    for i, p in enumerate(PATTERNS):
        hit = value.rlike(p.regex)
        own.append(F.when(_can(can, i), F.when(hit & VALIDATORS[p.validator](value) if p.validator else hit, F.lit(i))))
    return _names(F.coalesce(*own))


#: Cells of a column that a task takes together: Arrow bytes.
CELL_BYTES = 8 << 20


def _cells(table: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, v, can and n: the cells in which a pattern can occur. A value that repeats is searched once for each CELL_BYTES of its column."""
    search, limit = _search(list(range(len(PATTERNS)))), CELL_BYTES

    def count(batches):
        import pyarrow as pa

        held, size = [[] for _ in columns], [0] * len(columns)

        def found(k):
            seen = pa.chunked_array(held[k]).value_counts()
            held[k], size[k] = [], 0
            seen = seen.filter(seen.field("values").is_valid())
            at, can = search(seen.field("values"))
            seen = seen.take(at)
            if len(seen):
                name = pa.array([columns[k]] * len(seen), pa.string())
                yield pa.RecordBatch.from_arrays([name, seen.field("values"), can, seen.field("counts")], names=["column_name", "v", "can", "n"])

        for batch in batches:
            for k, values in enumerate(batch.columns):
                held[k].append(values)
                size[k] += values.nbytes
                if size[k] >= limit:
                    yield from found(k)
        for k in range(len(columns)):
            if held[k]:
                yield from found(k)

    return table.select(*[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(count, "column_name string, v string, can int, n bigint")


def _by_cell_type(found: DataFrame, *by: str) -> DataFrame:
    # as a generator, the search stays above the union; else each table would have its own copy of it to compile
    typed = found.select(*by, "n", F.explode(F.array(cell_type(F.col("v"), F.col("can")))).alias("pii_type"))
    return typed.where("pii_type is not null").groupBy(*by, "pii_type").agg(F.sum("n").alias("cells"))


def cells(table: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, pii_type and the number of cells, over the given string columns."""
    return _by_cell_type(_cells(table, columns), "column_name")


def all_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, pii_type and the number of cells, over every string column of all rows of the tables."""
    parts = []
    for name, rows in tables.items():
        own = [c for c, kind in rows.dtypes if kind == "string"]
        if own:
            parts.append(_cells(rows, own).withColumn("table_name", F.lit(name)))
    return _by_cell_type(reduce(DataFrame.unionAll, parts), "table_name", "column_name")


#: Words in a column's name and the class that they mean, first hit wins.
NAME_CLASSES = (("email", "mail", "email"), ("phone", "tel", "phone", "mobile"), ("ssn", "ssn", "secu", "social"), ("iban", "card", "account", "iban"), ("address", "city", "street", "address"))


def column_class(name: Column) -> Column:
    lower, out = F.lower(name), F.lit(None).cast("string")
    for label, *words in reversed(NAME_CLASSES):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in words]), F.lit(label)).otherwise(out)
    return out


#: Bits of the coarse flags that the native collector packs into one number.
FLAG_BITS = {"email": 0, "phone_fr": 1, "iban": 3, "credit_card": 4, "api_key": 13, "jwt_token": 15}
API_WORDS = ("access_token", "api-key", "api_key", "apikey", "secret_key")
PHONE_WORDS = ("+33", "06 ", "06.", "07 ", "07.")


def coarse_flags(text: Column) -> Column:
    """flags (bitmask), hits and hits per KB by substring counts alone. The counts are made once, as one structure."""
    times = lambda w: (F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)
    phone = reduce(lambda a, b: a + b, [times(w) for w in PHONE_WORDS]).cast("bigint")
    # a run of digits that is neither shorter nor longer: the rest of a longer one is taken with it
    runs = F.size(F.filter(F.regexp_extract_all(text, F.lit("[0-9]{13,}"), F.lit(0)), lambda x: F.length(x) <= 19))
    iban = F.contains(text, F.lit("FR")) & (F.regexp_count(text, F.lit("[0-9]")) > 20)
    api = F.lower(text).rlike("|".join(API_WORDS))
    jwt = F.contains(text, F.lit("eyJ")) & (times(".") >= 2)
    hits = {"email": times("@").cast("bigint"), "phone_fr": phone, "iban": iban.cast("bigint"), "credit_card": runs.cast("bigint"), "api_key": api.cast("bigint"), "jwt_token": jwt.cast("bigint")}
    once = F.array(F.struct(*[n.alias(k) for k, n in hits.items()]))

    def packed(h: Column) -> Column:
        flags = reduce(lambda a, b: a + b, [F.when(h[k] > 0, F.lit(1 << FLAG_BITS[k])).otherwise(0) for k in hits])
        total = reduce(lambda a, b: a + b, [h[k] for k in hits])
        # an empty text has 0 hits in 0 KB: not a number, as in the SQL, where a division would be an error
        density = F.when(F.octet_length(text) > 0, F.round(total / (F.octet_length(text) / 1024.0), 4)).otherwise(float("nan"))
        return F.struct(flags.cast("bigint").alias("flags"), total.alias("hits"), density.alias("density"))

    return F.get(F.transform(once, packed), F.lit(0))
