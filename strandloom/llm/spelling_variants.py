"""Spelling variants: forward and backward minimal acyclic automata of the vocabulary.

Two words that differ by one inserted, deleted or replaced letter agree exactly in
the first or in the last half of their letters. So every word is looked up twice:
a forward automaton takes its first half exactly and completes the rest with one
error; a backward one, of the words read from their ends, does the same with its
last half. Pairs that both find count once.

An automaton holds the words of one length. It is minimal: built from the sorted
words, with equal right languages merged from the last letter to the first.
Each transition counts the words that come before it, so the sums along a path
give a word's number without a gap (a perfect hash), which leads back to the word.
Construction and lookups take one numpy step per letter for all words of a
block together.

Spark deals the words by length and exact half, so both sides of a pair meet in one
task, and sorts them; a task builds the automata of one block of halves after the
other. A half that very many words share is cut into slices, and what is looked
up goes to all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import materialise, small, sql_crc32, table
from strandloom.llm.textbytes import blocks, lowered

# Fixed values of the contract: share of damaged runs, and the least letters, occurrences and ratio.
DAMAGE, LETTERS, OCCURRENCES, RATIO = 31, 7, 2, 10

#: Bytes of text that are counted at once, and words of a block of automata.
TEXT_BYTES, BLOCK = 1 << 20, 1 << 16
#: A half shared by more words than this is cut into slices of so many.
SLICE = 1 << 16
#: A table of up to so many sliced halves is broadcast.
BROADCAST_HALVES = 100_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)
#: Words of more bytes get their digest one by one.
_LONG_BYTES = 64


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to A-Z, a-z or U+00C0 to U+00FF (lead byte C3)."""
    word = _LETTER[data]
    lead = data == 0xC3
    word |= lead
    word[1:] |= lead[:-1]
    return word


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of blocks of texts; a longer text goes in pieces cut beside its words."""
    for lo, hi, data, offsets in blocks(texts, TEXT_BYTES):
        if len(data) <= 2 * TEXT_BYTES:
            yield np.arange(lo, hi), data, offsets
            continue
        at = 0
        while at < len(data):
            end = min(at + TEXT_BYTES, len(data))
            while end < len(data):
                gaps = np.flatnonzero(~letters(data[max(at, end - TEXT_BYTES) : end]))
                if len(gaps):
                    end = max(at, end - TEXT_BYTES) + int(gaps[-1]) + 1
                    break
                end = min(end + TEXT_BYTES, len(data))
            yield np.array([lo]), data[at:end], np.array([0, end - at])
            at = end


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, letters) of every run of letters."""
    word = letters(data)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts], last[cuts - 1] = word[cuts], word[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    leads = np.concatenate([[0], np.cumsum(data == 0xC3)])
    return np.searchsorted(offsets, start, "right") - 1, start, end, end - start - (leads[end] - leads[start])


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRC-32 of each word's bytes, going on from ``crc``."""
    length = end - start
    out = crc.astype(np.uint32)
    for i in np.flatnonzero(length > _LONG_BYTES):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(out[i]))
    short = np.flatnonzero(length <= _LONG_BYTES)
    short = short[np.argsort(-length[short], kind="stable")]
    state, size, begin = ~out[short], length[short], start[short]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))
        state[:n] = _CRC[(state[:n] ^ data[begin[:n] + j]) & np.uint32(255)] ^ state[:n] >> np.uint32(8)
    out[short] = ~state
    return out


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): damaged runs of at least :data:`LETTERS` letters, counted by themselves in every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for rows, data, offsets in pieces(batch.column(1)):
                data = lowered(data)
                row, start, end, size = runs(data, offsets)
                keep = size >= LETTERS
                row, start, end, size = row[keep], start[keep], end[keep], size[keep]
                head = np.array([zlib.crc32(f"{'' if ids[r] is None else ids[r]}:".encode()) for r in rows], np.uint32)
                h = digests(data, start, end, head[row])
                hit = h % DAMAGE == 0
                hurt = []
                for i in np.flatnonzero(hit & (size > LETTERS)):
                    w, p = data[start[i] : end[i]].tobytes().decode(), int(h[i]) % int(size[i])
                    hurt.append(w[:p] + w[p + 1 :])
                start, end = start[~hit], end[~hit]
                taken = np.zeros(len(data) + 1, np.int8)
                taken[start] += 1
                taken[end] -= 1
                body = data[np.cumsum(taken[:-1], dtype=np.int8) > 0]
                ends = np.concatenate([[0], np.cumsum(end - start)])
                whole = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)])
                found = pc.value_counts(pa.concat_arrays([whole, pa.array(hurt, pa.large_string())]))
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

    return docs.select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words with enough occurrences."""
    return counted(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


class Automaton:
    """Minimal acyclic automaton of distinct, sorted words of one length (a matrix of letters, one byte each).

    The states of a level are those after so many letters. Transitions of a level are
    sorted by 256 * state + letter, with the state they lead to and the number of
    the state's words that come before.
    """

    def __init__(self, words: np.ndarray):
        n, self.length = words.shape
        differs = words[1:] != words[:-1]
        fork = np.concatenate([[-1], np.argmax(differs, 1)]) if n > 1 else np.array([-1] * n)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [None] * self.length
        state, size = np.zeros(n, np.int64), np.ones(1, np.int64)  # of the last level: one, the end
        edges = np.arange(n)
        for d in range(self.length - 1, -1, -1):
            begins = fork[edges] < d
            parent = np.cumsum(begins) - 1
            letter, to = words[edges, d].astype(np.int64), state
            degree = np.bincount(parent)
            first = np.cumsum(degree) - degree
            # Prefixes of a state's list of transitions get a number each; equal lists, equal states.
            sign = np.zeros(len(degree), np.int64)
            for k in range(int(degree.max(initial=0))):
                more = np.flatnonzero(degree > k)
                e = first[more] + k
                sign[more] = np.unique((sign[more] * 256 + letter[e]) * len(size) + to[e], return_inverse=True)[1]
            _, chosen, state = np.unique(sign * 256 + degree, return_index=True, return_inverse=True)
            count = degree[chosen]
            own = np.repeat(np.arange(len(chosen)), count)
            e = np.repeat(first[chosen] - (np.cumsum(count) - count), count) + np.arange(len(own))
            words_of = size[to[e]]
            before = np.cumsum(words_of) - words_of
            start = np.cumsum(count) - count
            self.levels[d] = own * 256 + letter[e], to[e], before - before[start][own]
            size = np.bincount(own, words_of, minlength=len(chosen)).astype(np.int64)
            edges = edges[begins]

    def step(self, level: int, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether there is one, state after, words skipped) of a transition each."""
        keys, to, skipped = self.levels[level]
        key = state * 256 + letter
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[at] == key, to[at], skipped[at]

    def every(self, level: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which of ``state``, letter, state after, words skipped) of all transitions."""
        keys, to, skipped = self.levels[level]
        lo, hi = np.searchsorted(keys, state * 256), np.searchsorted(keys, state * 256 + 256)
        which = np.repeat(np.arange(len(state)), hi - lo)
        at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(which))
        return which, keys[at] & 255, to[at], skipped[at]

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``asked``, number of the word) of words with the first half of the row's letters and one error after it.

        Rows as long as the words: one letter is another. Rows one letter shorter: one is inserted.
        """
        m, inserts = self.length, asked.shape[1] < self.length
        half, shift = (m - 1) // 2, int(inserts)
        row, state, number = np.arange(len(asked)), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        bad_row, bad_state, bad_number = (np.zeros(0, np.int64) for _ in range(3))
        for d in range(m):
            if len(bad_row):
                ok, to, skipped = self.step(d, bad_state, asked[bad_row, d - shift])
                bad_row, bad_state, bad_number = bad_row[ok], to[ok], (bad_number + skipped)[ok]
            if d >= half and len(row):
                which, letter, to, skipped = self.every(d, state)
                if not inserts:
                    other = letter != asked[row[which], d]
                    which, to, skipped = which[other], to[other], skipped[other]
                bad_row = np.concatenate([bad_row, row[which]])
                bad_state, bad_number = np.concatenate([bad_state, to]), np.concatenate([bad_number, number[which] + skipped])
            if d < asked.shape[1]:
                ok, to, skipped = self.step(d, state, asked[row, d])
                row, state, number = row[ok], to[ok], (number + skipped)[ok]
        both = np.unique(np.stack([bad_row, bad_number], 1), axis=0)
        return both[:, 0], both[:, 1]


def _letters_of(words: pa.Array, length: int, backward: bool) -> np.ndarray:
    """Matrix of the words' code points, all below 256."""
    text = "".join(words.to_pylist()).encode("latin-1")
    m = np.frombuffer(text, np.uint8).reshape(len(words), length)
    return np.ascontiguousarray(m[:, ::-1]) if backward else m


def _pairs(block: pa.Table) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n), both ways round, of what the automata of one block find."""
    side, length, role = (block[c].to_numpy() for c in ("side", "m", "role"))
    group = side.astype(np.int64) << 40 | length.astype(np.int64)
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        m, backward = int(g & (1 << 40) - 1), bool(g >> 40)
        own = rows[role[rows] == 0]
        if not len(own):
            continue
        words, n = block["word"].take(pa.array(own)).combine_chunks(), block["n"].take(pa.array(own)).combine_chunks()
        matrix = _letters_of(words, m, backward)
        order = np.argsort(matrix.view(f"S{m}").ravel(), kind="stable")
        automaton, words, n = Automaton(matrix[order]), words.take(pa.array(order)), n.take(pa.array(order))
        for asking in (0, 1, 2):
            if asking == 0:
                asked, asked_n, letters_ = words, n, matrix[order]
            else:
                some = pa.array(rows[role[rows] == asking])
                if not len(some):
                    continue
                asked, asked_n = block["word"].take(some).combine_chunks(), block["n"].take(some).combine_chunks()
                letters_ = _letters_of(asked, m - (asking == 1), backward)
            a, b = automaton.near(letters_)
            a, b = pa.array(a), pa.array(b)
            one, two = (asked.take(a), asked_n.take(a)), (words.take(b), n.take(b))
            yield pa.RecordBatch.from_arrays([one[0], *two], ["word", "near", "near_n"])
            if asking:
                yield pa.RecordBatch.from_arrays([two[0], *one], ["word", "near", "near_n"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a partition sorted by half; blocks end between halves."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        rest = t
        if len(t) < BLOCK:
            continue
        same = np.ones(len(t) - 1, bool)
        for c in ("side", "m", "half", "slice"):
            x = t[c].combine_chunks()
            same &= np.asarray(pc.equal(x.slice(1), x.slice(0, len(x) - 1)))
        cut = np.flatnonzero(~same)
        if len(cut):
            yield from _pairs(t.slice(0, int(cut[-1]) + 1).combine_chunks())
            rest = t.slice(int(cut[-1]) + 1)
    if rest is not None and len(rest):
        yield from _pairs(rest.combine_chunks())


def near_pairs(words: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """(word, near, near_n): all pairs of (word, n) that differ by one letter, both ways round."""
    n = F.char_length("word")

    def row(side: int, role: int):
        m = n + 1 if role == 1 else n
        keep = F.floor((m - 1) / 2).cast("int")
        half = F.left("word", keep) if side == 0 else F.right("word", keep)
        return F.struct(F.lit(side).alias("side"), m.alias("m"), half.alias("half"), F.lit(role).alias("role"))

    key = ["side", "m", "half"]
    sizes = words.select(F.explode(F.array(row(0, 0), row(1, 0))).alias("x")).groupBy(*(F.col(f"x.{c}").alias(c) for c in key)).agg(F.count("*").alias("size"))
    hot = materialise(sizes.where(F.col("size") > slice_size).select(*key, F.ceil(F.col("size") / slice_size).cast("int").alias("slices")), "halves")
    rows = words.select("word", "n", F.explode(F.array(*(row(s, r) for s in (0, 1) for r in (0, 1)))).alias("x")).select("word", "n", "x.*")
    if hot.isEmpty():
        rows = rows.withColumn("slice", F.lit(0))
    else:
        # Words of a sliced half are also looked up in the slices of others.
        own = F.pmod(F.hash("word"), F.col("slices"))
        all_slices = F.sequence(F.lit(0), F.col("slices") - 1)
        to = lambda r, slices: F.transform(slices, lambda s: F.struct(F.lit(r).alias("role"), s.alias("slice")))
        asked = F.when(F.col("role") == 1, to(1, all_slices)).otherwise(F.concat(to(0, F.array(own)), to(2, F.array_remove(all_slices, own))))
        rows = rows.join(small(hot, BROADCAST_HALVES), key, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        rows = rows.select("word", "n", *key, F.explode(asked).alias("x")).select("word", "n", *key, "x.role", "x.slice")
    dealt = rows.repartition(*key, "slice").sortWithinPartitions(*key, "slice")
    return dealt.select("side", "m", "half", "slice", "role", "word", "n").mapInArrow(_searched, "word string, near string, near_n long").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form reached from (word, form). Counts rise tenfold along
    forms, so the doubled pointers settle after a few rounds."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        hop = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialise(now.select("word", "root").join(hop, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n)."""
    words = materialise(words, "vocabulary")
    best = near_pairs(words, slice_size).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    accepted = -F.col("best.less") >= RATIO * F.col("n")
    known = materialise(
        joined.select(
            "word", F.when(accepted, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(accepted, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    found = known.join(roots(known.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents.

    Null and empty texts have no word, a null id reads as empty, repeated rows count
    again, other columns are ignored; ties between forms go to the smallest in
    code-point order. Empty tables give no row. A very long text is read in pieces
    cut beside its words; a very long word takes one numpy step per letter.
    """
    return variants(vocabulary(table(spark, sf_dir, "documents")))


_BYTES = "flatten(list_transform(string_split({key}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END))"
_RUN = "[A-Za-z\\x{00C0}-\\x{00FF}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '{_RUN}')), '{_UPPER}', '{_UPPER.lower()}') AS run FROM documents),
d AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM runs WHERE length(run) >= {LETTERS} GROUP BY doc_id, run),
h AS (SELECT run, n, {sql_crc32(_BYTES.format(key="key"))} AS h FROM d),
w AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
del AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM del a JOIN del b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT del.word, words.word FROM del JOIN words ON del.rest = words.word UNION SELECT words.word, del.word FROM del JOIN words ON del.rest = words.word),
best AS (
  SELECT pairs.word, count(*) AS n_near, min({{'less': -v.n, 'form': near}}) AS b FROM pairs JOIN words v ON near = v.word GROUP BY pairs.word),
forms AS MATERIALIZED (
  SELECT words.word, CASE WHEN -b.less >= {RATIO} * n THEN b.form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {RATIO} * n THEN -b.less END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word),
walk AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, form FROM walk JOIN forms ON walk.root = forms.word WHERE form IS NOT NULL),
last AS (SELECT walk.word, root FROM walk JOIN forms ON root = forms.word WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
"""
