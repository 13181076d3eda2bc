"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a domain > language > source tree hold tokens (runs of characters
other than blank, tab and line ends). A token budget goes down the tree in
proportion to integer weights of domains, languages and sources (``Targets``).
A node can absorb its tokens times ``epochs``;
what a child cannot absorb goes to its siblings by their weights, and only what
a whole subtree cannot absorb reaches the siblings of its ancestors. All
arithmetic is on integers, so shares add up to the budget exactly.

Each leaf then takes whole epochs and a token prefix of one more. An epoch is an
order of the leaf's rows by a seeded hash of the epoch and doc_id. The row at
the end of the prefix gives only its first tokens.

The prefix is found in two steps, so that a leaf of any size is spread over the
cluster: token sums by hash range give the range in which the prefix ends, and
only that range is ordered by row.

Defined cases: a null language is ``und``, a null source the empty name, of
domain ``other``; a null doc_id hashes as the word null; a row without tokens
is never taken; rows with the same doc_id share a hash, and where the prefix
ends among them each gives an equal share, rounded down; an empty table gives
no rows; extra columns are kept by ``apply`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import bounded, checkpoint

SEED = 20240611
EPOCHS = 2
#: The budget as a share of all tokens.
TARGET = (9, 10)

@dataclass(frozen=True)
class Targets:
    """The tree and its weights: the sources of each domain, and the weights of domains, languages and sources; what has none weighs ``other``.

    A source that no domain names is of the domain ``other``.
    """

    domains: dict[str, tuple[str, ...]]
    domain_weights: dict[str, int]
    lang_weights: dict[str, int]
    source_weights: dict[str, int]
    other: int = 5

    def domain(self) -> str:
        """The domain of ``source``, as an expression of either engine."""
        names = lambda xs: ", ".join(_quoted(x) for x in xs)
        return f"case {' '.join(f'when source in ({names(v)}) then {_quoted(k)}' for k, v in sorted(self.domains.items()) if v)} else 'other' end" if any(self.domains.values()) else "'other'"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TARGETS = Targets(
    {"web": tuple(f"src{i}" for i in range(10)), "books": tuple(f"src{i}" for i in range(10, 14)), "reference": tuple(f"src{i}" for i in range(14, 17)), "news": ("src17", "src18")},
    {"web": 40, "books": 25, "reference": 20, "news": 10},
    {"en": 55, "fr": 18, "de": 17, "es": 10},
    {"src0": 20, "src1": 10, "src2": 10, "src10": 12, "src14": 8},
)
TOKEN = "[^ \\t\\r\\n]+"
#: Hash ranges of the first step of finding a prefix; it doesn't change the result.
RANGES_BITS = 12
_P = "_mix_"


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("bigint")


def seeded_hash(seed: int, epoch: Column, doc_id: str = "doc_id") -> Column:
    """60 bits of the MD5 of seed:epoch:doc_id."""
    word = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("bigint")


def _weight(column: str, weights: dict[str, int], other: int) -> Column:
    w = F.lit(other)
    for name, value in sorted(weights.items()):
        w = F.when(F.col(column) == name, value).otherwise(w)
    return w.cast("bigint")


def share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Divides each parent's ``budget`` (at most the sum of its children's ``cap``) among the children, by ``weight``, into ``alloc``."""
    if not parents:
        nodes = nodes.withColumn("_root", F.lit(0))
        parents = ["_root"]
    big = lambda c: F.col(c).cast("decimal(19,0)")
    order = Window.partitionBy(*parents).orderBy(F.col("cap").cast("double") / F.col("weight"), name)
    whole = Window.partitionBy(*parents)
    d = (
        nodes.withColumn("_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_left", F.col("budget") - F.col("_before"))
        .withColumn("_full", (big("cap") * big("_rest") <= big("_left") * big("weight")).cast("int"))
        .withColumn("_full", F.min("_full").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
        .withColumn("_w", F.when(F.col("_full"), 0).otherwise(F.col("weight")).cast("bigint"))
        .withColumn("_total", F.sum("_w").over(whole))
        .withColumn("_r", F.col("budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(whole))
        .withColumn("_c", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    part = "(_r div _total) * weight + (((_r % _total) * _c) div _total) - (((_r % _total) * (_c - weight)) div _total)"
    d = d.withColumn("alloc", F.when(F.col("_full"), F.col("cap")).otherwise(F.expr(part)))
    return d.drop("_before", "_rest", "_left", "_full", "_w", "_total", "_r", "_c", "_root")


def leaf_columns(docs: DataFrame, targets: Targets) -> DataFrame:
    """Adds the leaf, the token count and the row's key, under names that no table uses."""
    return docs.withColumns({
        _P + "domain": F.expr(targets.domain()),
        _P + "lang": F.coalesce(F.col("lang").cast("string"), F.lit("und")),
        _P + "source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        _P + "n": n_tokens(),
    })


def budgets(slim: DataFrame, targets: Targets = TARGETS, epochs: int = EPOCHS, target: tuple[int, int] = TARGET) -> DataFrame:
    """One row a leaf: its tokens and the tokens that it has to give."""
    leaves = slim.groupBy("domain", "lang", "source").agg(F.sum("n").alias("tokens")).withColumn("cap", F.col("tokens") * epochs)
    two = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    everything = Window.partitionBy(F.lit(0))
    top = top.withColumn("budget", F.least(F.expr(f"(sum(tokens) over (partition by 0) * {target[0]}) div {target[1]}"), F.sum("cap").over(everything)))
    top = share(top.withColumn("weight", _weight("domain", targets.domain_weights, targets.other)), [], "domain").select("domain", F.col("alloc").alias("budget"))
    two = share(two.join(top, "domain").withColumn("weight", _weight("lang", targets.lang_weights, targets.other)), ["domain"], "lang").select("domain", "lang", F.col("alloc").alias("budget"))
    return share(leaves.join(two, ["domain", "lang"]).withColumn("weight", _weight("source", targets.source_weights, targets.other)), ["domain", "lang"], "source").select(
        "domain", "lang", "source", "tokens", "alloc"
    )


def cutoffs(slim: DataFrame, alloc: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds to each leaf where the prefix of its last epoch ends: all rows of a lower hash, ``edge_take`` tokens of each row of that hash."""
    leaf = ["domain", "lang", "source"]
    alloc = alloc.withColumns({"full": F.expr("alloc div tokens"), "part": F.col("alloc") % F.col("tokens")})
    rows = slim.join(alloc, leaf).where("part > 0")
    rows = rows.select(*leaf, "n", "part", seeded_hash(seed, F.col("full")).alias("h")).withColumn("range", F.shiftright("h", 60 - RANGES_BITS))
    by_range = Window.partitionBy(*leaf).orderBy("range")
    sums = rows.groupBy(*leaf, "range").agg(F.sum("n").alias("n"), F.first("part").alias("part"))
    sums = sums.withColumn("upto", F.sum("n").over(by_range)).where("upto >= part and upto - n < part")
    edge = rows.drop("part").withColumnRenamed("n", "m").join(sums.select(*leaf, "range", (F.col("part") - F.col("upto") + F.col("n")).alias("part")), [*leaf, "range"])
    by_hash = Window.partitionBy(*leaf).orderBy("h")
    edge = edge.groupBy(*leaf, "h").agg(F.sum("m").alias("m"), F.count("*").alias("rows"), F.first("part").alias("part"))
    edge = edge.withColumn("upto", F.sum("m").over(by_hash)).where("upto >= part and upto - m < part")
    edge = edge.select(*leaf, F.col("h").alias("edge"), F.expr("(part - upto + m) div rows").alias("edge_take"))
    return alloc.join(edge, leaf, "left").select(*leaf, "full", "edge", "edge_take")


def _taken(rows: DataFrame, names: dict[str, str], seed: int) -> DataFrame:
    """Explodes each row into the epochs that take it; adds ``_mix_epoch`` and ``_mix_take``."""
    n, full = F.col(names["n"]), F.col(names["full"])
    h = seeded_hash(seed, full)
    last = F.when(h < F.col(names["edge"]), n).when(h == F.col(names["edge"]), F.least(n, F.col(names["edge_take"]))).otherwise(0)
    take = lambda e: F.struct(e.cast("int").alias("epoch"), F.when(e < full, n).otherwise(last).alias("take"))
    each = F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), full), take), lambda x: x["take"] > 0)
    rows = rows.where(n > 0).withColumn(_P + "e", F.explode(each))
    return rows.withColumns({_P + "epoch": F.col(_P + "e.epoch"), _P + "take": F.col(_P + "e.take")}).drop(_P + "e")


def _plan(docs: DataFrame, targets: Targets, seed: int, epochs: int, target: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    slim = leaf_columns(docs, targets).select(F.col(_P + "domain").alias("domain"), F.col(_P + "lang").alias("lang"), F.col(_P + "source").alias("source"), "doc_id", F.col(_P + "n").alias("n"))
    slim = checkpoint(slim.where("n > 0"))
    # the leaves go to the rows, as a hot leaf's rows must not meet in one task; very many leaves are joined by key
    return slim, bounded(cutoffs(slim, bounded(budgets(slim, targets, epochs, target)), seed))


def select(docs: DataFrame, targets: Targets = TARGETS, seed: int = SEED, epochs: int = EPOCHS, target: tuple[int, int] = TARGET) -> DataFrame:
    """The selection: doc_id, domain, lang, source, epoch, and the number of the row's tokens taken."""
    slim, cut = _plan(docs, targets, seed, epochs, target)
    rows = _taken(slim.join(cut, ["domain", "lang", "source"]), {k: k for k in ("n", "full", "edge", "edge_take")}, seed)
    return rows.select("doc_id", "domain", "lang", "source", F.col(_P + "epoch").alias("epoch"), F.col(_P + "take").alias("n_tokens"))


def apply(docs: DataFrame, targets: Targets = TARGETS, seed: int = SEED, epochs: int = EPOCHS, target: tuple[int, int] = TARGET) -> DataFrame:
    """The mixed documents, a row for each epoch that takes them, with the columns of ``docs``; a row taken in part keeps its first tokens, and n_chars follows the text."""
    slim, cut = _plan(docs, targets, seed, epochs, target)
    cut = cut.select(*[F.col(c).alias(_P + c) for c in cut.columns])
    rows = _taken(leaf_columns(docs, targets).join(cut, [_P + "domain", _P + "lang", _P + "source"]), {k: _P + k for k in ("n", "full", "edge", "edge_take")}, seed)
    pieces = F.regexp_extract_all("text", F.lit("[ \\t\\r\\n]*" + TOKEN), F.lit(0))
    cutting = F.col(_P + "take") < F.col(_P + "n")
    text = F.when(cutting, F.array_join(F.slice(pieces, F.lit(1), F.col(_P + "take").cast("int")), "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cutting, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def _case(column: str, weights: dict[str, int], other: int) -> str:
    return f"case {' '.join(f'when {column} = {_quoted(k)} then {v}' for k, v in sorted(weights.items()))} else {other} end" if weights else str(other)


def _share_sql(source: str, parents: str, name: str) -> str:
    by = f"partition by {parents or '0'}"
    order = f"{by} order by cap::double / weight, {name}"
    return f"""(select *, case when sat = 1 then cap else (r // total) * weight + ((r % total) * c) // total - ((r % total) * (c - weight)) // total end alloc from (
    select *, (budget - sum(case when sat = 1 then cap else 0 end) over ({by}))::bigint r, greatest(sum(case when sat = 1 then 0 else weight end) over ({by}), 1)::bigint total,
      sum(case when sat = 1 then 0 else weight end) over ({order} rows unbounded preceding)::bigint c from (
    select *, min(f) over ({order} rows unbounded preceding) sat from (
    select *, (cap::hugeint * sum(weight) over ({order} rows between current row and unbounded following)
       <= (budget - coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0))::hugeint * weight)::int f from {source}))))"""


def oracle(targets: Targets = TARGETS, seed: int = SEED, epochs: int = EPOCHS, target: tuple[int, int] = TARGET) -> str:
    h = f"('0x' || substr(md5('{seed}:' || \"full\" || ':' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint"
    return f"""with slim as (select doc_id, {targets.domain()} as domain,
    coalesce(lang, 'und') as lang, coalesce(source, '') as source, len(regexp_extract_all(text, '[^ \\t\\r\\n]+'))::bigint n from documents where len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) > 0),
  leaves as (select domain, lang, source, sum(n)::bigint tokens, (sum(n) * {epochs})::bigint cap, {_case('source', targets.source_weights, targets.other)}::bigint weight from slim group by all),
  top as (select domain, sum(cap)::bigint cap, {_case('domain', targets.domain_weights, targets.other)}::bigint weight, (select least((sum(tokens)::bigint * {target[0]}) // {target[1]}, sum(cap)) from leaves)::bigint budget from leaves group by domain),
  topa as (select domain, alloc budget from {_share_sql('top', '', 'domain')}),
  two as (select domain, lang, sum(cap)::bigint cap, {_case('lang', targets.lang_weights, targets.other)}::bigint weight, any_value(budget)::bigint budget from leaves join topa using (domain) group by domain, lang),
  twoa as (select domain, lang, alloc budget from {_share_sql('two', 'domain', 'lang')}),
  three as (select leaves.*, twoa.budget::bigint budget from leaves join twoa using (domain, lang)),
  leaf as (select domain, lang, source, (alloc // tokens)::bigint "full", (alloc % tokens)::bigint part from {_share_sql('three', 'domain, lang', 'source')}),
  rows_ as (select slim.*, "full", part, {h} h from slim join leaf using (domain, lang, source)),
  cum as (select *, sum(n) over (partition by domain, lang, source order by h rows unbounded preceding) upto from rows_),
  each as (select doc_id, domain, lang, source, n, part, upto, "full", unnest(range("full" + 1)) e from cum)
select doc_id, domain, lang, source, e::int as epoch, (case when e < "full" then n else least(n, greatest(0, part - (upto - n))) end)::bigint as n_tokens from each
where e < "full" or part - (upto - n) > 0"""
