"""The ten operators on small and awkward inputs, against brute force."""

import bisect
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm import _blocks as B
from riskweave.llm import ann, language_id, license_scan, mixing, ngram_join, packing, substring_dedup, token_output, topk_search, toxicity
from riskweave.llm._text import Words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n int, _text string, _sig bigint, score double, rank int, h string"
LONG = " ".join(f"word{i % 97} tail{i % 31}" for i in range(10_000))
PASSAGE = " ".join(f"passage{i}" for i in range(70))


def rows():
    texts = [
        (1, f"alpha beta {PASSAGE} gamma", "en", "src1"),
        (2, f"delta {PASSAGE} epsilon zeta", "en", "src2"),
        (3, "the quick brown fox jumps over the lazy dog near the river bank", "en", "src1"),
        (4, "the quick brown fox jumps over the lazy dog near the river bend", "en", "src1"),
        (5, "", "fr", None),
        (6, None, None, "src3"),
        (7, LONG, "de", "odd name"),
        (None, "no identifier here at all", "en", "src1"),
        (3, "the quick brown fox jumps over the lazy dog near the river bank", "en", "src1"),
        (8, "Released under the MIT License.\n\nwas soll das Licensed under the Apache License, Version 2.0.", None, "src4"),
        (9, " \n\t ", "en", "src1"),
        (10, "Released under the MIT License.", "en", "src4"),
        (10, "another text with the same identifier", "en", "src4"),
    ]
    return [(d, t, lg, s, None if t is None else len(t), "k", 1, "clash", 7, 0.5, 3, "h") for d, t, lg, s in texts]


@pytest.fixture(scope="module")
def docs(spark):
    from riskweave.llm._spark import ship

    ship(spark)
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_topk(spark, docs, none):
    queries = spark.createDataFrame([(1, "quick fox river"), (1, "bank"), (2, None), (3, ""), (4, "zzz nothing"), (None, "fox"), (5, "MIT license")], "item_id bigint, text string")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in topk_search.search(docs, queries, 3).orderBy("item_id", "rank").collect()]
    assert [g[:3] for g in got if g[0] == 1] == [(1, 1, 3), (1, 2, 3), (1, 3, 4)]
    assert {g[2] for g in got if g[0] == 5} == {8, 10} and {g[0] for g in got} == {1, 5}
    assert topk_search.search(none, queries).count() == 0 and topk_search.search(docs, queries.limit(0)).count() == 0


def test_topk_in_blocks_is_the_same(spark, docs, monkeypatch):
    queries = spark.createDataFrame([(i, f"fox word{i} river tail{i}") for i in range(9)], "item_id bigint, text string")
    whole = sorted(map(tuple, topk_search.search(docs, queries, 4).collect()))
    monkeypatch.setattr(topk_search, "BLOCK_WORDS", 10)
    assert sorted(map(tuple, topk_search.search(docs, queries, 4).collect())) == whole


def test_mixing(docs, none):
    got = mixing.select(docs).collect()
    tokens = {}
    for r in rows():
        tokens.setdefault(r[0], []).append(len((r[1] or "").split()))
    assert all(r.n_tokens <= max(tokens[r.doc_id]) for r in got) and {r.epoch for r in got} <= {0, 1, 2}
    total = sum(map(sum, tokens.values()))
    taken = sum(r.n_tokens for r in got)
    assert abs(taken - total * 9 // 10) <= 2  # repeated doc_ids share an edge, rounded down
    mixed = mixing.apply(docs)
    assert mixed.columns == docs.columns and mixed.agg(F.sum(mixing.n_tokens())).first()[0] == taken
    assert mixing.select(none).count() == 0 and mixing.apply(none).count() == 0


def test_shortages_go_to_siblings_first(spark):
    nodes = spark.createDataFrame([("a", 10, 1, 100), ("b", 1000, 1, 100), ("c", 1000, 2, 100)], "name string, cap bigint, weight bigint, budget bigint")
    assert {r.name: r.alloc for r in mixing.share(nodes, [], "name").collect()} == {"a": 10, "b": 30, "c": 60}


def test_packing(spark, docs, none):
    got = packing.pack(docs, capacity=16, classes=8, shard_rows=7, with_text=True).collect()
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r["class"], r["round"], r.bin), []).append(r)
        assert len(r.text.split()) == r.n_tokens <= 16 and r["class"] == min(8, 16 // r.n_tokens)
    assert {r.shard for r in got} == {0, 1}
    assert all(sum(x.n_tokens for x in b) <= 16 and sorted(x.slot for x in b) == list(range(len(b))) for b in bins.values())
    last = {}
    for s, c, o, b in bins:
        last[s, c, o] = max(b, last.get((s, c, o), 0))
    assert all(len(x) == c for (s, c, o, b), x in bins.items() if b < last[s, c, o])
    assert sum(r.n_tokens for r in got) == sum(len((r[1] or "").split()) for r in rows())
    assert packing.pack(none).count() == 0


def test_no_bin_holds_a_document_twice(spark):
    data = [(i, " ".join(["t"] * (3 + i % 4)), "epoch") for i in range(60)] * 3 + [(None, f"text {i % 2}", "") for i in range(6)] + [(5, "other words here", "")] * 2
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = packing.pack(df, capacity=24, classes=8, shard_rows=1000, with_text=True).collect()
    assert len(got) == len(data) and len({r.shard for r in got}) == 1
    bins = {}
    for r in got:
        bins.setdefault((r["class"], r["round"], r.bin), []).append((r.doc_id, r.text if r.doc_id is None else r.start))
    assert all(len(set(b)) == len(b) for b in bins.values())
    full = [len(b) / k[0] for k, b in bins.items() if k[1] < 3]
    assert sum(full) / len(full) > 0.8


def test_packing_fills_its_bins(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    tokens, bins = got.agg(F.sum("n_tokens"), F.count_distinct("shard", "class", "round", "bin")).first()
    assert tokens / (bins * packing.CAPACITY) > 0.8


def test_viterbi_against_plain(spark):
    rng = np.random.default_rng(3)
    for n, s in ((1, 2), (7, 3), (50, 4), (333, 2), (60, 200)):
        score, cost = rng.integers(-20, 20, (n, s)), np.full(n, 11)
        cost[rng.random(n) < 0.1] = 0
        best = score[0].copy()
        for t in range(1, n):
            best = np.maximum(best, best.max() - cost[t]) + score[t]
        path = language_id.viterbi(score, cost)
        value = score[np.arange(n), path].sum() - sum(cost[t] for t in range(1, n) if path[t] != path[t - 1])
        assert value == best.max()


def plain_language(text, model):
    """By plain loops: the language of each word, or None where no word of the text says anything."""
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())

    def script(word):
        found, strange = 0, False
        for ch in word:
            p = ord(ch)
            s = 1 if "a" <= ch <= "z" else 0
            if p >= 128:
                s = max([k for k, (_, _, ranges) in enumerate(language_id.SCRIPTS, 1) if any(a <= p < b for a, b in ranges)], default=0)
                strange |= not s and not (0x2000 <= p < 0x2070 or 0x3000 <= p < 0x3040 or 0xA0 <= p < 0xC0)
            found = max(found, s)
        return found or (len(language_id.SCRIPTS) + 1 if strange else 0)

    def score(word, state, s):
        if not s:
            return 0
        if not model.allowed[s][state]:
            return None
        if state not in model.trained:
            return 0
        b, total = word.encode(), 0
        for i, x in enumerate(b):
            code = (b[i - 1] if i else 32) << 16 | x << 8 | (b[i + 1] if i + 1 < len(b) else 32)
            total += int(model.table[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 16, model.trained.index(state)])
        return total

    kinds = [script(w) for w in words]
    if not any(kinds):
        return None
    best = None
    for w, k in zip(words, kinds):
        new = {}
        for state in range(len(model.languages)):
            own = score(w, state, k)
            if own is None:
                continue
            if best is None:
                new[state] = (own, [state])
                continue
            stay = best.get(state)
            value, way = max(((v, [-x for x in p]) for v, p in best.values()), key=lambda t: t[0])
            options = ([(stay[0], 1, stay[1])] if stay else []) + [(value - model.penalty, 0, [-x for x in way])]
            v, _, p = max(options, key=lambda t: (t[0], t[1]))
            new[state] = (v + own, [*p, state])
        best = new
    return best


def test_language_scores_against_plain_loops():
    rng = random.Random(4)
    letters = {"en": "abcdefgh", "fr": "cdefghéà", "ru": "абвгде"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7)))
    counts = {}
    for lang in letters:
        w = Words(pa.array([" ".join(word(lang) for _ in range(300))]))
        counts[lang] = np.bincount(language_id.trigrams(w)[0], minlength=1 << 16).astype(float)
    model = language_id.Model(counts, {"en": 1, "fr": 1, "ru": 3}, penalty=2.0)
    texts = [" ".join(word(rng.choice(["en", "en", "fr", "ru"])) if rng.random() < 0.8 else str(rng.randint(0, 99)) for _ in range(rng.randint(1, 40))) for _ in range(60)] + ["12 34", "ñ 日本 한국어 ★ 12"]
    words = Words(pa.array([t.lower() for t in texts]))
    path, states, _ = language_id.label(words, model)
    for i, t in enumerate(texts):
        best = plain_language(t, model)
        own = [states[x] for x in path[words.first[i] : words.first[i + 1]].tolist()]
        if best is None:
            continue
        # the value of the path found is the best value there is
        found = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        assert len(found) == len(own)
        value = 0
        score, own_states, _ = model.scores(Words(pa.array([t.lower()])))
        for j, x in enumerate(own):
            value += int(score[j, own_states.index(x)]) if x in own_states else 0
            value -= model.penalty if j and x != own[j - 1] else 0
        assert value == max(v for v, _ in best.values())


def test_scripts_by_all_their_ranges():
    want = {"à": "latin", "Ａ": "latin", "ἀ": "greek", "д": "cyrillic", "ᲀ": "cyrillic", "ﭐ": "arabic", "漢": "han", "㐀": "han", "𠀀": "han", "ア": "kana", "ｱ": "kana", "한": "hangul", "ㄱ": "hangul", "ღ": "georgian", "x": "latin"}
    names = [n for n, _, _ in language_id.SCRIPTS]
    got = language_id.scripts(Words(pa.array([c.lower() for c in want])))
    assert [names[g - 1] for g in got] == list(want.values())


def test_over_127_languages(spark):
    names = [f"l{i:03d}" for i in range(150)]
    docs = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q " * 12, n) for i, n in enumerate(names)] + [(1000, None, None), (1001, "12 34", None), (1002, "", None), (0, "zz zz", "l149")]
    got = {r.doc_id: r for r in language_id.spans(spark.createDataFrame([(i, t.strip() if t else t, n) for i, t, n in docs], "doc_id bigint, text string, lang string")).where("doc_id > 0").collect()}
    assert all(got[i].language == n and len(got[i].spans) == 1 for i, n in enumerate(names) if i > 1)
    assert [got[k].language for k in (1000, 1001, 1002)] == ["und"] * 3 and [s.lang for s in got[1001].spans] == ["und"]


def test_language_spans(spark, docs, none):
    en, fr = "the cat and the dog were with their house which there", "les maisons sont avec une grande quelque pour dans cette"
    train = [(i, " ".join(random.Random(i).sample(x.split(), 8)), lg) for i in range(40) for x, lg in ((en, "en"), (fr, "fr")) if (i % 2 == 0) == (lg == "en")]
    mixed = [(100, f"{en} {fr}", None), (101, "привет как дела", None), (102, None, None), (103, "12 34", None), (104, f"{en} 12 {en}", None)]
    got = {r.doc_id: r for r in language_id.spans(spark.createDataFrame(train + mixed, "doc_id bigint, text string, lang string")).collect()}
    assert [s.lang for s in got[100].spans] == ["en", "fr"] and abs(got[100].spans[0].n_words - 11) <= 1
    assert got[101].language == "ru" and got[102].language == "und" and got[102].spans == [] and [s.lang for s in got[104].spans] == ["en"]
    assert language_id.spans(docs).count() == len(rows()) and language_id.spans(none).count() == 0


def plain_classes(data):
    """By brute force: (doc_id, class_id, n_copies, n_links) of each distinct document and set."""
    own = set()
    for r in data:
        g = Words(pa.array([(r[1] or "").lower()])).grams(3)[0]
        own.add((r[0], frozenset(g.tolist())))
    sets = {s for _, s in own if s}
    links = {s: {t for t in sets if t != s and 2 * len(s & t) >= len(s | t)} for s in sets}
    out = []
    for d, s in own:
        group, new = {s}, [s]
        while new and s:
            x = new.pop()
            new += links[x] - group
            group |= links[x]
        ids = [i for i, t in own if t in group and i is not None]
        out.append((d, (min(ids) if ids else None) if s else d, sum(t == s for _, t in own) - 1 if s else 0, len(links[s]) if s else 0))
    return sorted(out, key=str)


def test_ngram_join_against_brute_force(docs, none):
    got = sorted(map(tuple, ngram_join.classes(docs).collect()), key=str)
    assert got == plain_classes(rows()) and any(r[3] for r in got)
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(map(str, [1, 3, 5, 6, 7, 8, 9, 10, 10, None])) and ngram_join.classes(none).count() == 0 and ngram_join.deduplicate(none).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_ngram_classes_of_clusters(spark, monkeypatch, small):
    """Chains, clusters of near copies, copies and repeated rows; with tiny fragments, parts and cells, too."""
    if small:
        for name, value in (("FRAGMENT_BYTES", 2000), ("FRAGMENT_GRAMS", 500), ("TASK_PAIRS", 50), ("CELL_PAIRS", 20), ("CELL_GRAMS", 300), ("CELL_SETS", 5), ("PARTS", 3)):
            monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    data = [(i, " ".join(base[i : i + 30]), "x") for i in range(30)]  # a chain
    for i in range(40, 90):  # a cluster
        words = [f"c{j}" for j in range(80)]
        words[rng.randrange(80)] = f"new{i}"
        data.append((i, " ".join(words), "y"))
    data += [(100 + i, " ".join(base[:30]), "z") for i in range(20)] + [(100, " ".join(base[:30]), "again"), (None, " ".join(base[:30]), "no id"), (None, "alone here now", ""), (200, "", ""), (201, None, "")]
    data += [(300 + i, " ".join(rng.choice(base) for _ in range(40)), "") for i in range(20)]
    df = spark.createDataFrame(data, "doc_id int, text string, source string").repartition(5)
    got = sorted(map(tuple, ngram_join.classes(df).collect()), key=str)
    assert got == plain_classes(data)
    kept = {(r.doc_id, r.text) for r in ngram_join.deduplicate(df).collect()}
    want = {(d, c) for d, c, _, _ in got if d == c}
    assert {(d, d) for d, _ in kept} == want and (None, "alone here now") in kept and len(kept) == len(want)
    named = df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert ngram_join.classes(named).count() == len(got)


def test_substring_dedup(docs, none):
    spans = {(r.doc_id, r.start, r.n_words, r.first_doc, r.first_start) for r in substring_dedup.spans(docs).collect()}
    assert {(1, 2, 70, 1, 2), (2, 1, 70, 1, 2)} <= spans and all(s[0] in (1, 2, 7) for s in spans)
    out = substring_dedup.remove(docs)
    assert out.columns == docs.columns and out.count() == len(rows())
    got = {r.doc_id: r for r in out.collect()}
    assert PASSAGE in got[1].text and got[2].text == "delta epsilon zeta" and got[2].n_chars == len("delta epsilon zeta") and got[6].text is None
    assert len(got[7].text.split()) < len(LONG.split()) and substring_dedup.remove(none).count() == 0 and substring_dedup.spans(none).count() == 0


def test_false_repeats_are_dropped(spark, monkeypatch):
    """A path whose hashes agree and whose words don't, as by a collision, is neither reported nor removed."""
    data = [("a", f"one {PASSAGE} two"), ("b", f"{PASSAGE} three"), ("c", " ".join(f"other{i}" for i in range(90))), (None, f"four {PASSAGE}")]
    df = spark.createDataFrame(data, "doc_id string, text string")
    assert substring_dedup.paths(df).where("first_start = 1").count() in (0, 3) and {r.doc_id for r in substring_dedup.spans(df).collect()} == {"a", "b", None}
    true = substring_dedup.paths(df)
    sig = {r[1]: r[0] for r in true.select("sig", "doc_id").collect()}
    c = int(substring_dedup.signatures(Words(pa.array([data[2][1]]))).view(np.int64)[0])
    ids = {r[1]: r[0] for r in df.select(substring_dedup._key(df), "doc_id").collect()}
    false = [(ids["c"], c, 3, 11, ids["a"], sig[ids["a"]], 1), (ids["c"], c, 85, 11, ids["a"], sig[ids["a"]], 1), (ids["b"], sig[ids["b"]], 1, 11, ids["c"], c, 70)]
    both = true.unionByName(spark.createDataFrame(false, true.schema))
    monkeypatch.setattr(substring_dedup, "paths", lambda docs, k=50: both)
    assert {r.doc_id for r in substring_dedup.spans(df).collect()} == {"a", "b", None}
    left = {r.doc_id: r.text for r in substring_dedup.remove(df).collect()}
    assert left["c"] == data[2][1] and sorted(len(x.split()) for x in left.values()) in ([1, 2, 71, 90], [1, 1, 72, 90])


@pytest.mark.parametrize("hot", [0, 2, 10**9])
def test_substring_dedup_against_brute_force(spark, monkeypatch, hot):
    """With all repeated k-mers hot, some, and none."""
    monkeypatch.setattr(substring_dedup, "HOT_COUNT", hot)
    monkeypatch.setattr(substring_dedup, "HOT_MOST", 30 if hot == 2 else 10**6)
    monkeypatch.setattr(substring_dedup, "FRAGMENT_BYTES", 300)
    rng, k = random.Random(1), 4
    words = {d: [rng.choice("abc") for _ in range(rng.randrange(0, 40))] for d in range(25)}
    first, want = {}, {d: set() for d in words}
    for d in sorted(words):
        for p in range(len(words[d]) - k + 1):
            g = tuple(words[d][p : p + k])
            if g in first:
                want[d].update(range(p, p + k))
            first.setdefault(g, (d, p))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in words.items()] + [(7, " ".join(words[7]))] * 3, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.text for r in substring_dedup.remove(df, k).collect()}
    assert {d: t.split() for d, t in got.items()} == {d: [x for i, x in enumerate(w) if i not in want[d]] for d, w in words.items()}


def test_substring_dedup_fragments_keep_stretches_together():
    """However many fragments there are, a document's k-mers come to few of them at a time; equal k-mers come to the same one."""
    rng, k = random.Random(2), 50
    texts = [" ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(5000)}"]) for _ in range(n)) for n in (0, 3, 50, 4000, 700)]
    words = Words(pa.array([*texts, "x y z " + texts[3]]))
    h, doc, pos = substring_dedup._kmers(words, k)
    fragment = B.fragment_of(substring_dedup._anchors(words, k)[words.first[doc] + pos], 3000)
    at = {}
    assert all(at.setdefault(x, f) == f for x, f in zip(h.tolist(), fragment.tolist()))
    new = (doc[1:] != doc[:-1]) | (fragment[1:] != fragment[:-1])
    assert new.sum() < len(h) / 10 and len(set(fragment.tolist())) > 100
    rows_ = [pos[:0], pos[:1], pos[1:3000], pos[3000:]]
    low, high = (pa.chunked_array([pa.array(x, pa.binary())]) for x in zip(*map(substring_dedup._planes, rows_)))
    assert (substring_dedup._from_planes(low, high) == pos).all() and sum(np.count_nonzero(np.frombuffer(x, np.uint16) != 1) for x in low.chunk(0).to_pylist()) < 10


def test_substring_dedup_cuts_each_run_once(spark, docs):
    """A run that occurs often is cut once at the nodes of its source; runs without a node inside aren't there."""
    quotes = [(d, 7, 0, 40, 1, 9, 100, None, None, None) for d in range(50)] + [(d, 7, 40, 5, 1, 9, 110, 1, 9, 129) for d in range(3)] + [(80, 7, 0, 1, 1, 9, 110, None, None, None), (81, 7, 0, 9, 2, 9, 0, None, None, None), (82, 7, 0, 2, 1, 9, 110, None, None, None)]
    found = spark.createDataFrame(quotes, substring_dedup._RUNS)
    assert [tuple(r) for r in substring_dedup.cuts(found).collect()] == [(1, 9, 100, 40, [100, 110, 130, 140])]


def plain_neighbours(x, q, k=ann.K):
    """By brute force: the k vectors whose larger one of distance and reach is least, in the order of distance."""
    lines = ann.directions(x.shape[1], ann.PROJECTIONS)
    need = ann.threshold(ann.PROJECTIONS, ann.HALF_WIDTH, ann.CONFIDENCE)
    p = x.astype(float) @ lines
    d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
    reach = np.sort(np.abs(p - p[q]), axis=1)[:, need - 1] / ann.HALF_WIDTH
    radius = np.maximum(d, reach)
    radius[q] = np.inf
    o = np.lexsort((np.arange(len(x)), d, radius))[:k]
    return o[np.lexsort((o, d[o].round(12)))], np.sort(d[np.arange(len(x)) != q])[k - 1]


def test_nearest_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:80] = x[50]
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(0, x[0].tolist(), 1), (900, None, 1), (None, x[1].tolist(), 1), (901, [], 1), (902, [1.0, 2.0], 1), (903, [float("nan")] * 16, 1), (904, [None] * 16, 1)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, rank int")
    whole = ann.neighbors(df).toPandas().sort_values(["vec_id", "rank"]).reset_index(drop=True)
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES", 32)
    monkeypatch.setattr(ann, "GROUP_BYTES", 4096)
    got = ann.neighbors(df, sample=40).toPandas().sort_values(["vec_id", "rank"]).reset_index(drop=True)
    assert whole.equals(got)  # however the vectors are split
    assert set(got.vec_id) == set(range(300)) and (got.groupby("vec_id").size() == 10).all()
    hit = 0
    for v, g in got.groupby("vec_id"):
        want, kth = plain_neighbours(x, v)
        assert sorted(g.neighbor) == sorted(want) or np.allclose(np.sort(g.distance), np.sort(np.sqrt(((x[want].astype(float) - x[v]) ** 2).sum(1))), atol=1e-5)
        hit += (g.distance <= kth + 1e-5).sum()
        assert v not in set(g.neighbor)
    assert hit / 3000 >= 0.9
    assert ann.neighbors(df.limit(0)).count() == 0 and ann.neighbors(df, df.limit(0)).count() == 0
    some = ann.neighbors(df, df.where("vec_id % 20 = 0")).toPandas()
    assert some.sort_values(["vec_id", "rank"]).reset_index(drop=True).equals(whole[whole.vec_id % 20 == 0].reset_index(drop=True))
    named = df.where("vec_id < 40").withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    assert {r.vec_id for r in ann.neighbors(named).collect()} == {f"v{i}" for i in range(40)}


def test_distances_are_computed_after_collisions(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(data.embedding.values).astype(np.float32), data.vec_id.to_numpy().astype(np.int64)
    lines, need = ann.directions(x.shape[1], ann.PROJECTIONS), ann.threshold(ann.PROJECTIONS, ann.HALF_WIDTH, ann.CONFIDENCE)
    search = ann.Search(ids[::20], x[::20], np.full(len(ids[::20]), np.inf), lines, ann.K, ann.HALF_WIDTH, need)
    search.visit(ann.Arrays(ids[:500], x[:500], lines))
    before = search.verified
    for a in range(500, len(ids), 500):
        search.visit(ann.Arrays(ids[a : a + 500], x[a : a + 500], lines))
    assert search.verified - before < len(ids[::20]) * 1500 / 3  # the share falls as the bound does with more vectors
    hits = 0
    for j, i in enumerate(range(0, len(ids), 20)):
        d = np.sqrt(((x.astype(float) - x[i]) ** 2).sum(1))
        d[i] = np.inf
        hits += (search.best[j][1] <= np.sort(d)[ann.K - 1] + 1e-9).sum()
    assert hits / (len(search.best) * ann.K) >= 0.9


def test_chain_on_held_out_rows(spark):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(200)]
    data, labels = [], []
    for i in range(900):
        toxic, low = rng.random() < 0.2, rng.random() < 0.4
        words = [rng.choice(plain) for _ in range(30)] + (["vileword", "slurish"] if toxic else []) + (["junk"] * 2 if low else [])
        rng.shuffle(words)
        data.append((i, " ".join(words), int(toxic)))
        if i < 600:
            labels.append((i, 0 if low else 1, int(toxic)))
    labels += [(5, None, 1), (None, 1, 0), (99999, 1, 1), (labels[0][0], labels[0][1], labels[0][2])]
    docs = spark.createDataFrame(data + [(5000, None, 0), (5001, "", 0)], "doc_id bigint, text string, toxic int")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity.score(docs, lab).collect()}
    held = [(t, got[i]) for i, _, t in data[600:]]
    assert sum(t == r for t, r in held) / len(held) > 0.97 and not got[5000] and not got[5001]
    kept = toxicity.keep_clean(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(not r for r in got.values())
    assert toxicity.score(docs, lab.limit(0)).where("rejected").count() == 0 and toxicity.score(docs.limit(0), lab).count() == 0


def test_chain_scores_against_plain_sums(spark, docs):
    """Probabilities by adding up the weights of the features of a text, one by one; on the awkward table, too."""
    rng = random.Random(3)
    data = [(i, " ".join(rng.choice(["vile", "kind", "calm", "junky", "word"]) + str(rng.randint(0, 3)) for _ in range(20)), i % 2) for i in range(400)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, "vile0 vile1"), (7, "kind0 calm"), (7, "kind0 calm"), (900, None), (901, ""), (902, LONG)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int("junky" not in t), int(t.count("vile") > 3)) for i, t, _ in data] + [(7, 1, 1), (8, None, 1), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    chain = toxicity.train(texts, labels)
    assert [(m.bias, m.weights.tolist()) for m in chain] == [(m.bias, m.weights.tolist()) for m in toxicity.train(texts.repartition(7), labels.repartition(3))]

    def plain(text):
        seen = set()
        for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower()):
            seen |= {int(x[0]) for x in toxicity.features(Words(pa.array([w])))}
        odds = []
        for m in chain:
            n = len(m.hashes)
            own = {int(h): float(x) for h, x in zip(m.hashes, m.weights)}
            odds.append(m.bias + sum(own.get(h, 0.0) for h in seen) + sum(float(a) * b for a, b in zip(m.weights[n:], odds)))
        return [1 / (1 + np.exp(-o)) for o in odds]

    for r in toxicity.score(texts, labels).join(texts, "doc_id").where("doc_id % 10 = 7 or doc_id >= 900").collect():
        if r.doc_id != 7:
            assert np.allclose([r.p_low_quality, r.p_toxic], plain(r.text), atol=1e-9) and r.rejected == (r.p_toxic >= 0.5)
    awkward = toxicity.score(docs, labels.where("doc_id < 9"))
    assert awkward.count() == len(rows()) and toxicity.keep_clean(docs, labels.where("doc_id < 9")).columns == docs.columns
    one = toxicity.score(texts, labels.withColumn("toxic", F.lit(1)))
    assert one.where("rejected").count() == 0 and abs(one.first().p_toxic - 0.499) < 1e-6


def test_later_models_are_trained_on_out_of_fold_odds():
    """The fit's gradient vanishes at its solution, with odds of earlier categories from models that didn't see the row."""
    rng = np.random.default_rng(5)
    n, m = 300, 12
    present = rng.random((n, m)) < 0.3
    y = np.stack([present[:, 0] | (rng.random(n) < 0.1), present[:, 1] | (rng.random(n) < 0.1)], 1).astype(float)
    rows_, index = np.nonzero(present)
    own = np.arange(m, dtype=np.uint64) * np.uint64(7) + np.uint64(1)
    chain = toxicity.fit_chain(rows_, own[index], n, y, np.ones(n))
    odds = np.zeros(n)
    for f in range(toxicity.FOLDS):
        test = np.arange(n) % toxicity.FOLDS == f
        to = np.cumsum(~test) - 1
        use = ~test[rows_]
        model = toxicity.Linear.fit(to[rows_[use]], index[use], own, int((~test).sum()), y[~test, 0], np.ones(int((~test).sum())), np.zeros((int((~test).sum()), 0)))
        for i in np.flatnonzero(test):
            odds[i] = model.bias + sum(model.weights[list(model.hashes).index(own[j])] for j in np.flatnonzero(present[i]) if own[j] in model.hashes)
    for j, model, earlier in ((0, chain[0], np.zeros((n, 0))), (1, chain[1], odds[:, None])):
        x = np.column_stack([present[:, [list(own).index(h) for h in model.hashes]], earlier]).astype(float)
        p = 1 / (1 + np.exp(-(x @ model.weights + model.bias)))
        assert np.abs(x.T @ (p - y[:, j]) / n + toxicity.PENALTY * model.weights).max() < 2e-3 and abs((p - y[:, j]).mean()) < 2e-3


def plain_decode(payload, n, freq, precision):
    """A decoder of one block by integers of any size, token by token."""
    start = np.concatenate([[0], np.cumsum(freq)]).tolist()
    lanes = token_output.LANES
    states = [int.from_bytes(payload[8 * i : 8 * i + 8], "little") for i in range(lanes)]
    words = [int.from_bytes(payload[i : i + 4], "little") for i in range(8 * lanes, len(payload), 4)]
    out = []
    for i in range(n):
        x = states[i % lanes]
        slot = x & ((1 << precision) - 1)
        t = bisect.bisect_right(start, slot) - 1
        x = (start[t + 1] - start[t]) * (x >> precision) + slot - start[t]
        if x < 1 << 31:
            x = x << 32 | words.pop(0)
        states[i % lanes] = x
        out.append(t)
    assert not words and all(x == 1 << 31 for x in states)
    return out


def test_an_independent_decoder_reads_the_blocks(spark, docs):
    out = token_output.output(docs).collect()
    table = np.frombuffer(bytes(next(r.payload for r in out if r.block == -1)), "<u4").astype(np.int64)
    encoding = token_output._encoding(token_output.VOCABULARY)
    whole = {}
    for r in sorted((r for r in out if r.block >= 0 and r.payload is not None and r.doc_id in (1, 2, 4, 5, 7, 9)), key=lambda r: (r.doc_id, r.block)):
        ids = plain_decode(bytes(r.payload), r.n_tokens, table, token_output.PRECISION)
        assert zlib.crc32(np.array(ids, "<u2").tobytes()) == r.checksum
        whole.setdefault(r.doc_id, []).extend(ids)
    texts = {r[0]: r[1] for r in rows()}
    assert {d: encoding.decode(ids) for d, ids in whole.items()} == {d: texts[d] for d in (1, 2, 4, 5, 7, 9)}


def test_token_blocks_round_trip(spark, docs, none, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK", 512)
    monkeypatch.setattr(token_output, "CHECKPOINT", 64)
    out = token_output.output(docs)
    encoding = token_output._encoding(token_output.VOCABULARY)
    blocks = out.where("block >= 0").collect()
    table = np.frombuffer(bytes(out.where("block = -1").first().payload), "<u4").astype(np.int64)
    assert table.sum() == 1 << token_output.PRECISION
    back = {}
    for b in sorted((b for b in blocks if b.payload is not None and b.doc_id not in (3, 10, None)), key=lambda b: b.block):
        ids = token_output.decode([bytes(b.payload)], np.array([b.n_tokens]), table)[0]
        assert token_output._checksum(ids, False) == b.checksum
        for c in b.checkpoints:
            part = token_output.decode([bytes(b.payload)], np.array([b.n_tokens]), table, [(c.token, c.word, bytes(c.states))])[0]
            assert (part == ids[c.token :]).all()
        back.setdefault(b.doc_id, []).extend(ids.tolist())
    assert all(encoding.decode(ids) == next(r[1] for r in rows() if r[0] == d) for d, ids in back.items()) and set(back) == {1, 2, 4, 5, 7, 8, 9}
    assert [b.n_tokens for b in blocks if b.doc_id == 6] == [None] and token_output.output(none).count() == 1


def test_damage_is_noticed(spark, docs):
    out = token_output.output(docs.where("doc_id = 4"))
    assert token_output.read_back(out).count() == 1
    broken = out.withColumn("payload", F.when(F.col("block") == 0, F.concat(F.unhex(F.lit("FFFFFF")), F.expr("substring(payload, 4)"))).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="checksum"):
        token_output.read_back(broken).collect()


def test_tokens_are_those_of_the_library():
    texts = ["", " ", "  a  b c ", "x  y", "a 　b c\u0085 d", "can't won't  x 'll a", "日本 語 の ", "é è à", "\n\n a \n b", "a b c d e", "👍 👍🏽 ok 12 34", LONG]
    known = token_output.Pieces(token_output.VOCABULARY)
    for _ in range(2):
        ids, at = token_output.tokenize(pa.array(texts), known)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [known.encoding.encode_ordinary(t) for t in texts]


def test_frequencies_fill_the_table():
    for counts in ([0, 1, 0], [1] * 1000, [10**12, 1, 1, 0], [3, 3, 3]):
        f = token_output.scale(np.array(counts), 10)
        assert f.sum() == 1024 and ((f > 0) == (np.array(counts) > 0)).all()


def test_license_scan(docs, none):
    got = {(r.doc_id, r.block, r.template) for r in license_scan.scan(docs).collect()}
    assert {(10, 0, "mit"), (8, 0, "mit"), (8, 2, "apache-2.0")} <= got and {g[0] for g in got} == {8, 10}
    assert license_scan.scan(none).count() == 0 and license_scan.scan(docs, {"empty": "..."}).count() == 0


@pytest.mark.parametrize("width", [72, 40, 20])
def test_license_scan_finds_wrapped_notices(spark, width):
    names = list(license_scan.TEMPLATES)
    texts = ["x = y\n\n" + "\n".join(" * " + line for line in textwrap.wrap("Notice: " + " ".join(license_scan.TEMPLATES[n].split()), width)) + "\n\ncode" for n in names]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {n for i, n in enumerate(names) if any((r.doc_id, r.template) == (i, n) and r.block >= 2 for r in got)} == set(names)


def passages(text, template, least=4 / 5):
    """By brute force: (block, overlap) of the lines and of the passages over lines."""
    lines = [line.split() for line in text.split("\n")]
    words, length = set(template.split()), -(-len(template.split()) * 3 // 2)
    full = {i for i, line in enumerate(lines) if len(words & set(line)) >= least * len(words)}
    out = [(i, len(words & set(lines[i]))) for i in sorted(full)]
    flat = [(i, w) for i, line in enumerate(lines) for w in line]
    own = [(n, i, w) for n, (i, w) in enumerate(flat) if w in words and i not in full]
    free = j = 0
    while j < len(own):
        starts = [i for i in range(free, j + 1) if own[j][0] - own[i][0] < length and len({w for *_, w in own[i : j + 1]}) >= least * len(words)]
        j += 1
        if starts:
            i, has = starts[-1], {w for *_, w in own[starts[-1] : j]}
            free = j
            for k in range(j, len(own)):
                if own[k][0] - own[i][0] < length and own[k][2] not in has:
                    has, free = has | {own[k][2]}, k + 1
            out.append((own[i][1], len(has)))
            j = free
    return out


def test_license_passages(spark):
    rng = random.Random(5)
    templates = {f"t{i}": " ".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for i in range(6)}
    texts = ["".join(rng.choice("abcdefghxy") + rng.choice([" ", " ", "\n", "\n\n"]) for _ in range(rng.choice([0, 5, 60, 200]))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r.doc_id, r.template, r.block, r.overlap) for r in license_scan.scan(docs, templates).collect())
    want = sorted((i, t, b, n) for i, x in enumerate(texts) for t, words in templates.items() for b, n in passages(x, words))
    assert got == want and len(want) > 100


def test_labels_without_documents_take_no_place(spark):
    texts = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} words number{i}") for i in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2, i % 2) for i in range(6000)], "doc_id bigint, quality int, toxic int")
    here = toxicity.train(texts, labels.where("doc_id < 300"), rows=60)
    both = toxicity.train(texts, labels, rows=60)
    assert [(list(m.hashes), m.bias) for m in here] == [(list(m.hashes), m.bias) for m in both] and len(here[-1].hashes)
