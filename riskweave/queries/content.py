"""Content analysis of document texts as bytes, with some bytes changed so that every branch occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content
from ._common import Query, table

#: Hex prefixes by doc_id, so that signatures, byte-order marks and zero bytes occur.
_PREFIX = "case doc_id % 9 when 1 then 'EFBBBF' when 2 then 'FFFE' when 3 then '255044462D312E342F456E6372797074' when 4 then '504B030414000100' when 5 then '8502' when 6 then '00FF00FF' when 7 then 'E9E9' else '' end"


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.expr(f"concat(unhex({_PREFIX}), cast(text as binary))").alias("b"))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("b")
    return blobs(spark, sf_dir).select("doc_id", content.magic(b).alias("magic_bytes"), content.is_binary(b).alias("is_binary"), content.encoding(b).alias("encoding"))


def entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("b")
    rows = blobs(spark, sf_dir).select("doc_id", "b", content.entropy(b).alias("entropy"))
    return rows.select("doc_id", F.round("entropy", 3).alias("entropy"), content.encrypted(b, F.col("entropy")).alias("encrypted"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("b")
    return blobs(spark, sf_dir).select("doc_id", content.content_hash(b).alias("content_hash"), content.full_hash(b).alias("full_hash"))


_B = f"(select doc_id, hex(unhex({_PREFIX}) || encode(text)) as h from documents where text is not null)"
_HEX = "string_split(regexp_replace({}, '(..)', '\\1,', 'g'), ',')"
_SEQ = "(?:[0-7].|C[2-9A-F][89AB].|D.[89AB].|E0[AB].[89AB].|E[1-9A-CEF][89AB].[89AB].|ED[89].[89AB].|F0[9AB].[89AB].[89AB].|F[123][89AB].[89AB].[89AB].|F48.[89AB].[89AB].)"
_ENC = f"""case when starts_with(h, 'EFBBBF') then 1 when starts_with(h, 'FFFE') then 2 when starts_with(h, 'FEFF') then 3 when not regexp_matches(left(h, 2048), '^(..)*[89A-F]') then 4
  when regexp_full_match(left(h, 2048), '{_SEQ}*') then 1 else 5 end"""
_ENT = f"""(select doc_id, -sum(n::double / t * log2(n::double / t)) e, any_value(h) h from (select doc_id, any_value(h) h, any_value(t) t, count(*) n from (
  select doc_id, h, least(length(h) / 2, 4096) t, unnest({_HEX.format('left(h, 8192)')}) c from {_B}) where c <> '' group by doc_id, c) group by doc_id)"""
_CRYPT = "starts_with(h, '2D2D2D2D2D424547494E20504750') or starts_with(h, '53616C7465645F5F') or starts_with(h, '8502') or starts_with(h, '8C0D') or (starts_with(h, '504B0304') and substr(h, 14, 1) in ('1','3','5','7','9','B','D','F')) or (starts_with(h, '255044462D') and regexp_matches(left(h, 8192), '^(..)*2F456E6372797074')) or (e > 7.5 and length(h) >= 2048)"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "content_magic_encoding": (details, f"select doc_id, lower(left(h, 8)) as magic_bytes, regexp_matches(left(h, 2048), '^(..)*00') as is_binary, ({_ENC})::int as encoding from {_B}"),
    "content_entropy": (entropies, f"select doc_id, case when length(h) < 16 then 0.0 else round(round(e, 4), 3) end as entropy, ({_CRYPT}) as encrypted from {_ENT}"),
    "content_hash": (hashes, f"select doc_id, case when h = '' then '' else sha256(unhex(left(h, 131072))) end as content_hash, sha256(unhex(h)) as full_hash from {_B}"),
}
