"""Golden values of the validators, the patterns and the three modes."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from riskweave.functions.patterns import BY_NAME, GATES, PATTERNS
from riskweave.functions.validators import VALIDATORS
from riskweave.operators import pii

GOLDEN = {
    "dni": (["12345678Z"], ["12345678A", "1234567Z", "ABCDEFGHZ", "", None]),
    "nie": (["X0000000T", "Y0000000Z"], ["X1234567A", None]),
    "nif": (["123456789"], ["123456788", "012345678", "312345678"]),
    "pesel": (["02070803628"], ["44051401358", "1234567890"]),
    "bsn": (["111222333"], ["123456789", "12345678"]),
    "niss": (["85073003328", "85.07.30-033.28"], ["85073003329"]),
    "codice_fiscale": (["RSSMRA85M01H501Q"], ["RSSMRA85M01H501Z", ""]),
    "iban": (["FR7630006000011234567890189", "DE89370400440532013000", "FR76 3000 6000 0112 3456 7890 189"], ["FR7630006000011234567890188", "FR76", "", None]),
}
HITS = {
    "email": ["ann.lee@example.co.uk"],
    "phone_fr": ["+33612345678", "06 12 34 56 78", "0612345678"],
    "ssn_fr": ["1 85 12 75 108 008 42"],
    "gender": ["Gender: Male", "sex=female", "Sexe: F", "genderqueer identity"],
    "credit_card": ["4111111111111111", "5105105105105100", "340000000000009"],
    "bank_routing_us": ["routing: 021000021", "ACH #021000021", "wire transfer 121000358"],
    "health_data": ["her medical record", "Patient"],
    "salary_data": ["fiche de paie"],
    "tax_id_keyword": ["form W-2"],
    "api_key": ["AKIA" + "A" * 16, "ghp_" + "a1" * 18],
    "secret_env": ["x; DB_PASSWORD = hunter2", "JWT_SECRET=abc"],
}
MISSES = {"gender": ["The old man", "male connector"], "bank_routing_us": ["021000021", "ID: 121000358"], "phone_fr": ["106123456789"], "email": ["a@b", "@x.org"], "health_data": ["impatiently"]}


def test_registry():
    assert len(PATTERNS) == 30 and len({p.name for p in PATTERNS}) == 30
    assert sum(p.validator is not None for p in PATTERNS) == 9
    assert all(p.gate in GATES for p in PATTERNS)


@pytest.mark.parametrize("kind", sorted(GOLDEN))
def test_validators(spark, kind):
    good, bad = GOLDEN[kind]
    rows = spark.createDataFrame([(v, v in good) for v in good + bad], "v string, want boolean").withColumn("got", VALIDATORS[kind](F.col("v")))
    assert [r for r in rows.collect() if r.want != r.got] == []


def test_validators_against_plain_python(spark):
    random.seed(5)
    values = [f"{random.randrange(10**11):011d}" for _ in range(400)]

    def nif(v):
        s = sum(int(v[i]) * (9 - i) for i in range(8)) % 11
        return v[0] in "1256789" and int(v[8]) == (0 if s < 2 else 11 - s)

    spec = {
        "bsn": (9, lambda v: (sum(int(v[i]) * (9 - i) for i in range(8)) - int(v[8])) % 11 == 0),
        "nif": (9, nif),
        "pesel": (11, lambda v: (10 - sum(int(c) * w for c, w in zip(v, (1, 3, 7, 9) * 3)) + int(v[10]) * 7) % 10 == int(v[10])),
    }
    for kind, (n, f) in spec.items():
        rows = spark.createDataFrame([(v[:n],) for v in values], "v string").withColumn("got", VALIDATORS[kind](F.col("v")))
        assert all(r.got == f(r.v) for r in rows.collect()), kind


def test_patterns(spark):
    rows = [(k, v, True) for k, vs in HITS.items() for v in vs] + [(k, v, False) for k, vs in MISSES.items() for v in vs]
    for name in {r[0] for r in rows}:
        own = spark.createDataFrame([r for r in rows if r[0] == name], "k string, v string, want boolean")
        got = own.withColumn("got", pii._gate(BY_NAME[name].gate, F.col("v")) & F.col("v").rlike(BY_NAME[name].regex))
        assert [r for r in got.collect() if r.want != r.got] == []


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_line_mode_counts_a_value_once(spark):
    many = "\n".join(f"user{i % 10}@example.com" for i in range(50))
    phone = "a@x.org\nb@x.org A@X.ORG\n06 12 34 56 78"
    iban = "FR7630006000011234567890189 DE89370400440532013000"
    docs = _docs(spark, many, phone, iban, "", None, "912-34-5678")
    got = {r.doc_id: r for r in pii.per_document(pii.matches(docs, "doc_id", "text"), "doc_id").collect()}
    assert (got[0].pii_count, got[0].data_subjects) == (10, 10)
    assert got[1].data_subjects == 3
    assert (got[2].pii_types, got[2].data_subjects) == (["iban"], 0)
    assert got[5].pii_types == ["ssn_us"] and set(got) == {0, 1, 2, 5}


def test_block_mode_counts_repeats_of_one_family(spark):
    docs = _docs(spark, "a@x.org b@x.org c@x.org A@x.org", "FR7630006000011234567890189", "FR76 3000 6000 0112 3456 7890 189", "routing: 021000021")
    found = pii.matches(docs, "doc_id", "text", "block")
    got = {r.doc_id: r for r in pii.per_document(found, "doc_id").collect()}
    assert (got[0].pii_count, got[0].data_subjects) == (4, 3)
    assert (got[1].pii_count, got[1].pii_types) == (1, ["iban"]) and got[2].pii_types == ["iban_fr"]
    assert found.where("type = 'bank_routing_us'").first().value == "021000021"


def test_cells(spark):
    rows = spark.createDataFrame([("987-65-4321", "IBAN: FR7630006000011234567890189"), (None, "FR7630006000011234567890189")], "a string, account_iban string")
    assert {(r.column_name, r.pii_type) for r in pii.cells(rows, ["a", "account_iban"]).collect()} == {("a", "ssn_us"), ("account_iban", "iban")}
    names = spark.createDataFrame([("E_Mail",), ("mobile",), ("social_no",), ("card",), ("city",), ("id",)], "n string")
    assert [r[0] for r in names.select(pii.column_class(F.col("n"))).collect()] == ["email", "phone", "ssn", "iban", "address", None]


def test_all_cells(spark):
    one = spark.createDataFrame([(1, "see a@example.org", "x"), (2, None, "987-65-4321"), (3, "b@example.org", None)], "id int, text string, `odd name` string")
    got = pii.all_cells({"one": one, "two": one.select("id"), "three": one.select("text")}).collect()
    assert {tuple(r) for r in got} == {("one", "text", "email", 2), ("one", "odd name", "ssn_us", 1), ("three", "text", "email", 2)}


def test_all_tables_search_every_string_column(spark):
    from riskweave.queries.pii import QUERIES

    got = {r.table_name: r for r in QUERIES["pii_all_tables"][0](spark, "/root/testdata/sf0.01").collect()}
    assert "text" in got["documents"].pii_columns.split(",") and "email" in got["documents"].pii_types.split(",") and "contacts" in got


def test_previews_are_masked_and_few(spark):
    docs = _docs(spark, "\n".join(f"user{i}@example.com" for i in range(25)))
    rows = pii.previews(pii.matches(docs, "doc_id", "text"), "doc_id").collect()
    assert len(rows) == 10 and {r.value_preview for r in rows} == {"user..."}


def test_coarse_flags_of_an_empty_text(spark):
    got = {r.doc_id: r for r in _docs(spark, "", "a@b").select("doc_id", pii.coarse_flags(F.col("text")).alias("f")).select("doc_id", "f.*").collect()}
    assert (got[0].flags, got[0].hits, math.isnan(got[0].density)) == (0, 0, True)
    assert (got[1].flags, got[1].hits, got[1].density) == (1, 1, 341.3333)


def test_loose_patterns_miss_nothing(spark):
    """Where Java finds a pattern, its loose form has been found: among letters, blanks and ends of lines that the engines take differently, too."""
    from riskweave.queries.pii import SAMPLES

    random.seed(8)
    own = [*SAMPLES.values(), *(v for vs in HITS.values() for v in vs), "x.y@a.org|\u00e9", ".z@b.org", "non\U0001f600binaire", "steuer-id", "sexe\x0b=\x0bf", "fr76\x0b3000600001123456789018 9"]
    near = ["", " ", "\u00e9", "e\u0301", "\x0b", "\r", "\x85", "\u2028", "_", "7", "|", ".", "\U0001f600", "\u017f", "\u212a"]
    texts = [random.choice(near) + (t.upper() if random.random() < 0.3 else t.replace(" ", random.choice([" ", "\x0b", "\u00e9"]))) + random.choice(near) + random.choice(["", t]) for t in own for _ in range(40)]
    rows = _docs(spark, *texts).union(spark.range(1).select(F.lit(-1), F.concat(F.unhex(F.lit("FFC3")).cast("string"), F.lit(" a@x.org")))).withColumnRenamed("text", "_text")
    can = pii._candidates(rows, list(range(len(PATTERNS))))
    both = rows.join(can.select("doc_id", "_can"), "doc_id", "left").withColumn("_can", F.coalesce("_can", F.lit(0)))
    hits = both.select(*[F.count_if(F.col("_text").rlike(p.regex)).alias(p.name) for p in PATTERNS]).first()
    missed = both.select(*[F.count_if(F.col("_text").rlike(p.regex) & ~pii._can(F.col("_can"), i)).alias(p.name) for i, p in enumerate(PATTERNS)]).first()
    assert min(hits) > 0 and max(missed) == 0, (hits, missed)


def test_cells_that_repeat_are_searched_once_and_the_others_not_at_all(spark):
    rows = spark.range(1000).select(F.lit("N").alias("flag"), F.when(F.col("id") % 2 == 0, "a@x.org").alias("mail"), F.when(F.col("id") == 7, "mosque").alias("odd name")).coalesce(1)
    got = {(r.column_name, r.v): r.n for r in pii._cells(rows, rows.columns).collect()}
    assert got == {("mail", "a@x.org"): 500, ("odd name", "mosque"): 1}
    assert {tuple(r) for r in pii.all_cells({"t": rows, "u": rows.limit(0)}).collect()} == {("t", "mail", "email", 500), ("t", "odd name", "religious", 1)}


def test_line_and_block_search_only_texts_that_can_match(spark):
    docs = _docs(spark, "nothing here\n" * 50, "x\n06 12 34 56 78\ny", "in 2019, 7 of 12", None, "see a@x.org\nat the mosque")
    rows = docs.where("text is not null").withColumnRenamed("text", "_text")
    bit = {p.name: 1 << i for i, p in enumerate(PATTERNS)}
    assert {r.doc_id: r._can for r in pii._candidates(rows, list(range(len(PATTERNS)))).collect()} == {1: bit["phone_fr"], 4: bit["email"] | bit["religious"]}
    for mode in ("line", "block"):
        assert {(r.doc_id, r.type) for r in pii.matches(docs, "doc_id", "text", mode).collect()} == {(1, "phone_fr"), (4, "email"), (4, "religious")}
    assert {r.type for r in pii.raw_matches(docs, "doc_id", "text", patterns=["religious"]).collect()} == {"religious"}


def test_table_summary_searches_each_table_once(spark):
    from riskweave.queries.pii import QUERIES, _STRINGS

    plan = QUERIES["pii_table_summary"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == sum(map(bool, _STRINGS.values())) + 1 and plan.count("Generate ") == 1


def test_re2_spelling_has_no_lookaround():
    assert not [p.name for p in PATTERNS if re.search(r"\(\?[=!<]", p.re2 or p.regex)]
