"""Languages of the spans of a text, which may mix several.

Each word has a script, by the code-point ranges of its letters (the later one
in SCRIPTS where it mixes them), and only languages of that script are its
candidates. Languages that the labelled documents name are told apart by byte
trigrams: a word's score for a language is the sum over its bytes of the
log-probability of the trigram around it, less the mean over languages. A script
with no such language stands for one language by itself. Viterbi's algorithm
then labels all words of a text at once, the best sum of scores less PENALTY for
each switch of language. Words of digits only have no candidates of their own
and take what their neighbours have; a text of such words alone is ``und``.

Scores are integers, so sums don't depend on the order of additions; on ties
staying beats switching and the earlier language in the alphabet the later.

The trigrams come from a bounded sample, the ROWS documents of each label that
are least by a hash of doc_id; every document is labelled, by its whole text.

Defined cases: a text that is null or has no words has language ``und`` and no
spans; so have words of a script that is in no range; documents whose lang or
doc_id is null aren't learnt from; without labels each script stands for its
language; repeated rows are labelled each, and learnt from each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ._spark import bounded, ship
from ._text import Words, chunked

ROWS = 800
PENALTY = 9.0
_SCALE = 64
_SLOTS = 1 << 16
_NEVER = -(1 << 40)
#: Script, its language where no label is of that script, and its code-point ranges.
SCRIPTS: tuple[tuple[str, str, tuple[tuple[int, int], ...]], ...] = (
    ("latin", "la", ((0xAA, 0xAB), (0xB5, 0xB6), (0xBA, 0xBB), (0xC0, 0x250), (0x1E00, 0x1F00), (0xFF21, 0xFF5B))),
    ("greek", "el", ((0x370, 0x400), (0x1F00, 0x2000))),
    ("cyrillic", "ru", ((0x400, 0x530), (0x1C80, 0x1C90), (0x2DE0, 0x2E00))),
    ("armenian", "hy", ((0x530, 0x590),)),
    ("hebrew", "he", ((0x590, 0x600),)),
    ("arabic", "ar", ((0x600, 0x700), (0x750, 0x780), (0xFB50, 0xFE00), (0xFE70, 0xFF00))),
    ("devanagari", "hi", ((0x900, 0x980),)),
    ("bengali", "bn", ((0x980, 0xA00),)),
    ("tamil", "ta", ((0xB80, 0xC00),)),
    ("thai", "th", ((0xE00, 0xE80),)),
    ("georgian", "ka", ((0x10A0, 0x1100), (0x1C90, 0x1CC0))),
    ("ethiopic", "am", ((0x1200, 0x13A0),)),
    ("han", "zh", ((0x2E80, 0x2FE0), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x32000))),
    ("kana", "ja", ((0x3040, 0x3100), (0x31F0, 0x3200), (0xFF66, 0xFFA0))),
    ("hangul", "ko", ((0x1100, 0x1200), (0x3130, 0x3190), (0xAC00, 0xD7B0))),
)
_OTHER = len(SCRIPTS) + 1
_ASCII = np.zeros(256, np.uint8)
_ASCII[65:91] = _ASCII[97:123] = 1
_bounds = sorted(x for s, (_, _, ranges) in enumerate(SCRIPTS, 1) for a, b in ranges for x in ((a, s), (b, 0)))
_starts = [(0, 0)]
for _p, _s in _bounds:
    if _p == _starts[-1][0]:
        _starts[-1] = (_p, max(_s, _starts[-1][1]))
    else:
        _starts.append((_p, _s))
_AT, _SCRIPT = np.array([p for p, _ in _starts]), np.array([s for _, s in _starts], np.uint8)


def scripts(words: Words) -> np.ndarray:
    """The script of each word: 0 for digits alone, 1.. as in SCRIPTS, then one for none of them."""
    data = words.data
    kind = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
        b0, b1, b2, b3 = (padded[lead + j] for j in range(4))
        point = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
        s = _SCRIPT[np.searchsorted(_AT, point, "right") - 1]
        mark = (point >= 0x2000) & (point < 0x2070) | (point >= 0x3000) & (point < 0x3040) | (point >= 0xA0) & (point < 0xC0)
        kind[lead] = np.where(s > 0, s, np.where(mark, 0, 255))
    if not len(words):
        return np.zeros(0, np.int64)
    flag = words._flag
    size = words.end - words.begin
    known = kind[flag]
    at = np.cumsum(size) - size
    some = np.maximum.reduceat(np.where(known == 255, 0, known), at)
    return np.where(some > 0, some, np.where(np.maximum.reduceat(known, at) == 255, _OTHER, 0)).astype(np.int64)


def trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The slot of the trigram around each byte of each word, and where each word's begin."""
    left, right = np.empty_like(words.data), np.empty_like(words.data)
    if len(left):
        left[1:], right[:-1] = words.data[:-1], words.data[1:]
        left[words.begin], right[words.end - 1] = 32, 32
    flag = words._flag
    code = left[flag].astype(np.uint32) << 16 | words.data[flag].astype(np.uint32) << 8 | right[flag]
    size = words.end - words.begin
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16), np.cumsum(size) - size


class Model:
    """languages: sorted names; table: slots x trained languages; allowed: script x language."""

    def __init__(self, counts: dict[str, np.ndarray], script_of: dict[str, int], penalty: float = PENALTY):
        trained = sorted(counts)
        lone = [lang for s, (_, lang, _) in enumerate(SCRIPTS, 1) if s not in script_of.values() and lang not in counts]
        self.languages = sorted({*trained, *lone, "und"})
        self.trained = [self.languages.index(x) for x in trained]
        self.allowed = np.zeros((_OTHER + 1, len(self.languages)), bool)
        self.allowed[0] = True
        for lang in trained:
            self.allowed[script_of[lang], self.languages.index(lang)] = True
        for s, (_, lang, _) in enumerate(SCRIPTS, 1):
            if not self.allowed[s].any():
                self.allowed[s, self.languages.index(lang)] = True
        self.allowed[_OTHER, self.languages.index("und")] = True
        logs = np.stack([np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * _SLOTS)) for x in trained], 1) if trained else np.zeros((_SLOTS, 0))
        self.table = np.round((logs - logs.mean(1, keepdims=True)) * _SCALE).astype(np.int32) if trained else logs.astype(np.int32)
        self.penalty = int(penalty * _SCALE)

    def scores(self, words: Words) -> tuple[np.ndarray, list[int], np.ndarray]:
        """words x states, for the languages that are a candidate of some word here; these languages; and the words' scripts."""
        script = scripts(words)
        states = np.flatnonzero(self.allowed[np.unique(script[script > 0])].any(0)).tolist() if (script > 0).any() else [self.languages.index("und")]
        out = np.zeros((len(script), len(states)), np.int64)
        slot, at = trigrams(words)
        for j, s in enumerate(states):
            if s in self.trained:
                out[:, j] = np.add.reduceat(self.table[slot, self.trained.index(s)], at, dtype=np.int64)
        out[script == 0] = 0
        out[~self.allowed[script][:, states]] = _NEVER
        return out, states, script


def viterbi(score: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The best state of each word; penalty[t]: the cost of a switch on entering word t, 0 where a text begins.

    The words are cut into about sqrt(n) blocks, which are handled side by side:
    first what each block adds between any two states, then the state values on
    entering each block, then the path, from the last block to the first.
    """
    n, s = score.shape
    if n == 0 or s == 1:
        return np.zeros(n, np.int64)
    width = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // width)
    pad = blocks * width - n
    e = np.concatenate([score, np.zeros((pad, s), np.int64)]).reshape(blocks, width, s)
    cost = np.concatenate([penalty, np.zeros(pad, np.int64)]).reshape(blocks, width)
    eye = np.where(np.eye(s, dtype=bool), 0, 2 * _NEVER * 1024)
    through = np.broadcast_to(eye, (blocks, s, s)).copy()  # from state before the block to state now
    for t in range(width):
        best = through.max(2, keepdims=True) - cost[:, t, None, None]
        through = np.maximum(through, best) + e[:, t, None, :]
    value = np.zeros((blocks + 1, s), np.int64)
    for b in range(blocks):
        value[b + 1] = (value[b][:, None] + through[b]).max(0)
        value[b + 1] -= value[b + 1].max()
    v = value[:-1].copy()
    back = np.empty((width, blocks, s), np.int16)
    for t in range(width):
        top = v.argmax(1)
        switched = v[np.arange(blocks), top] - cost[:, t]
        stay = v >= switched[:, None]
        back[t] = np.where(stay, np.arange(s), top[:, None])
        v = np.where(stay, v, switched[:, None]) + e[:, t]
    entry = np.broadcast_to(np.arange(s), (blocks, s)).copy()  # state on entering, for each state at the end
    for t in range(width - 1, -1, -1):
        entry = np.take_along_axis(back[t].astype(np.int64), entry, 1)
    state = np.empty(blocks, np.int64)
    now = int(value[-1].argmax())
    for b in range(blocks - 1, -1, -1):
        state[b], now = now, int(entry[b, now])
    path = np.empty((blocks, width), np.int64)
    for t in range(width - 1, -1, -1):
        path[:, t] = state
        state = back[t, np.arange(blocks), state]
    return path.ravel()[:n]


def train(docs: DataFrame, rows: int = ROWS, penalty: float = PENALTY) -> Model:
    """Trigram counts of each label's sample, and the script of most of its words."""
    known = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    mark = F.xxhash64(F.lit("language"), F.col("doc_id"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(mark, "doc_id"))
    picked = known.withColumn("_place", place).where(F.col("_place") <= rows).select("doc_id", "lang").distinct()
    picked = bounded(picked)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            words = Words(batch.column("text"))
            if not len(words):
                continue
            langs, which = np.unique(np.array(batch.column("lang").to_pylist()), return_inverse=True)
            (slot, _), size, script, owner = trigrams(words), words.end - words.begin, scripts(words), which[words.doc]
            for j, lang in enumerate(langs):
                c = np.bincount(slot[np.repeat(owner == j, size)], minlength=_SLOTS)
                s = np.bincount(script[owner == j], minlength=_OTHER + 1)
                keys = np.concatenate([np.flatnonzero(c), -1 - np.flatnonzero(s)])
                if not len(keys):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(keys)), pa.array(keys), pa.array(np.concatenate([c[c > 0], s[s > 0]]))], names=["lang", "key", "n"])

    text = docs.select("doc_id", F.col("lang"), F.lower("text").alias("text")).join(picked, ["doc_id", "lang"])
    sums = text.mapInArrow(write, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    counts, script_of = {}, {}
    for lang, own in sums.groupby("lang"):
        c = np.zeros(_SLOTS)
        c[own.key[own.key >= 0].to_numpy()] = own.n[own.key >= 0].to_numpy()
        s = own[(own.key < -1) & (own.key >= -_OTHER)].sort_values(["n", "key"])
        if len(s):
            counts[lang], script_of[lang] = c, int(-1 - s.key.iloc[-1])
    return Model(counts, script_of, penalty)


def label(words: Words, model: Model) -> tuple[np.ndarray, list[int], np.ndarray]:
    """The state of each word, the languages that the states are, and the words' scripts."""
    score, states, script = model.scores(words)
    penalty = np.full(len(words), model.penalty)
    penalty[words.first[:-1][words.counts > 0]] = 0
    return viterbi(score, penalty), states, script


def spans(docs: DataFrame, rows: int = ROWS, penalty: float = PENALTY) -> DataFrame:
    """doc_id, language of most words, n_words, and the spans: start (word), n_words and lang."""
    ship(docs.sparkSession)
    model = train(docs, rows, penalty)
    names = np.array(model.languages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            words = Words(batch.column("text"))
            path, states, script = label(words, model) if len(words) else (np.zeros(0, np.int64), [0], np.zeros(0, np.int64))
            doc, first = words.doc, words.first
            und = np.bincount(doc, weights=script > 0, minlength=batch.num_rows) == 0  # no word says anything
            new = np.append(True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])) if len(path) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(path)))
            lang = np.where(und[doc[at]], "und", names[np.array(states)[path[at]]]) if len(at) else np.zeros(0, str)
            items = pa.StructArray.from_arrays([pa.array((at - first[doc[at]]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(lang.tolist(), pa.string())], names=["start", "n_words", "lang"])
            offsets = np.searchsorted(doc[at], np.arange(batch.num_rows + 1)).astype(np.int32)
            share = np.zeros((batch.num_rows, len(states)), np.int64)
            np.add.at(share, (doc[at], path[at]), n)
            top = np.where(~und, names[np.array(states)[share.argmax(1)]], "und")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(top.tolist(), pa.string()), pa.array(words.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["doc_id", "language", "n_words", "spans"])

    schema = docs.select("doc_id").schema.add("language", "string").add("n_words", "long")
    schema = schema.add("spans", ArrayType(StructType().add("start", IntegerType()).add("n_words", IntegerType()).add("lang", StringType())))
    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(write, schema)
