"""Token ids in wavelet-matrix shards.

Documents are range-partitioned by id and encoded in order; every task closes a
shard when it holds :data:`SHARD_TOKENS` ids, so memory is bounded by a shard
and the longest document. A shard is a self-contained file image (see
:mod:`strandloom.llm.wavelet`), kept as one row of a Parquet table, whose
writer commits whole tasks only: a lost executor's shards are written again,
never twice. ``wavelet.WaveletFile`` also opens an image saved as a plain file.

Encoding cuts texts where this tokenizer's own rules cut them (white space, and
between letters, digits and marks) and encodes each distinct piece of a batch
once; see :class:`PieceEncoder`.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm import wavelet
from strandloom.llm.common import materialise, no_null, small, table
from strandloom.llm.textbytes import blocks, lowered

END = 2
SHARD_TOKENS = 1 << 19
#: Bytes of text, with a few for each row, meant for each partition.
PARTITION_BYTES = 16 << 20
ROW_BYTES = 64
#: Characters of a text that take part in its place in the order.
HEAD = 32
#: Text bytes encoded at once.
BATCH_BYTES = 4 << 20
#: Tables of up to so many partitions (16 bytes each) are broadcast.
BROADCAST_PARTS = 100_000
#: Pieces that a worker remembers; it forgets all when there are more.
CACHE_PIECES = 500_000


_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[33:127] = _MARK
_KIND[39] = _OTHER  # an apostrophe may begin a contraction
_KIND[48:58] = _DIGIT
_KIND[97:123] = _LETTER
_SIMPLE = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[!-&(-/:-@\[-`{-~]+|[0-9]")


# The rules that pieces rely on, as tokenizer files spell them.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def _byte_letters() -> str:
    """The characters that stand for the bytes 0 to 255 in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


class PieceEncoder:
    """Encodes texts piece by piece, with a bounded memory of pieces.

    A piece is what the tokenizer's own rules separate anyway: a run of letters,
    a single digit or a run of marks. A word that holds anything but ASCII and
    the letters of Latin-1, or an apostrophe, is one piece and goes through the
    whole tokenizer as it stands; simple pieces are lower-cased and go straight
    to its merge model. A tokenizer with other rules encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.known_rules = all(said.get(k) == v for k, v in _RULES.items())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(_byte_letters()))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _ids(self, piece: str) -> list[int]:
        if not _SIMPLE.fullmatch(piece):
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(spelled)]

    def _learn(self, pieces: list[str]) -> None:
        ids = [self._ids(p) for p in pieces]
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in ids])])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32)])
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces)), strict=True))

    @staticmethod
    def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all rows, and the number of pieces before each row."""
        given, data = data, lowered(data)
        kind = _KIND[data]
        lead = np.flatnonzero(data == 0xC3)  # the letters of Latin-1, but for two signs
        second = data[lead + 1]
        letter = (second != 0x97) & (second != 0xB7)
        kind[lead] = kind[lead + 1] = np.where(letter, _LETTER, _OTHER)
        data[lead + 1] += np.where(letter & (second <= 0x9E), 0x20, 0).astype(np.uint8)
        full = kind != _SPACE
        first = full.copy()
        first[1:] &= ~full[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = full[cuts]
        words = np.flatnonzero(first)
        if not len(words):
            return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
        odd = np.repeat(np.maximum.reduceat(kind, words) == _OTHER, np.diff(np.append(words, len(data))))
        # Composition comes before lower-casing, so an odd word keeps its case.
        data[words[0] :] = np.where(odd, given[words[0] :], data[words[0] :])
        change = kind == _DIGIT
        change[1:] |= kind[1:] != kind[:-1]
        change &= full
        change[words[0] :] &= ~odd
        begin = np.flatnonzero(first | change)
        packed = np.cumsum(full)
        ends = np.append(packed[begin] - 1, packed[-1]).astype(np.int64)
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(data[full])]
        return pa.Array.from_buffers(pa.large_string(), len(begin), buffers), np.searchsorted(begin, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each row)."""
        pieces, bounds = self._pieces(data, offsets)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.place]
        if new:
            if len(self.place) + len(new) > CACHE_PIECES:
                self._forget()
                new = distinct
            self._learn(new)
        known = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        at = known[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else known
        first, length = self.starts[at], self.starts[at + 1] - self.starts[at]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(first - total[:-1], length)]
        return ids, total[bounds[1:]] - total[bounds[:-1]]

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids end to end, number of ids of each row) of parts of a batch.

        Texts that hold the name of a special token are encoded whole, and so are
        all texts if the tokenizer's rules aren't those of :data:`_RULES`.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.full(len(texts), not self.known_rules)
        for s in self.special:
            odd |= pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        usual = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        for lo, hi, data, offsets in blocks(usual, BATCH_BYTES):
            ids, sizes = self.encode(data, offsets)
            if odd[lo:hi].any():
                parts, end = [], 0
                for i, n in enumerate(sizes.tolist()):
                    own = ids[end : end + n]
                    end += n
                    if odd[lo + i]:
                        own = np.array(self.tokenizer.encode(texts[lo + i].as_py(), add_special_tokens=False).ids, np.uint32)
                    parts.append(own)
                ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
            yield lo, ids, sizes


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


_SHARDS = "part int, shard int, before long, n_tokens long, image binary"
_NAMES = ["part", "shard", "before", "n_tokens", "image"]


def write_shards(docs: DataFrame, tokenizer: str, text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode and write; returns the shard table read back from its files.

    Documents lie in ascending id order over (part, shard), nulls first; rows
    with the same id lie in the order of their first characters, then of a digest
    of their texts, so the rows of one id can be dealt to many tasks. Null and
    empty texts are just the end id. Other columns are ignored. ``before``: ids of
    the same part in earlier shards.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    parts = max(1, -(-size // PARTITION_BYTES))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        shard, before = 0, 0
        held, names, ends = [], [], []
        total = 0

        def close() -> pa.RecordBatch:
            image = wavelet.build(np.concatenate(held), names, np.array(ends))
            row = [[part], [shard], [before], [total], [image]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], _NAMES)

        for batch in batches:
            keys = batch.column(0)
            for lo, ids, sizes in encoder.batches(batch.column(1)):
                # An end id after every document.
                stop = np.cumsum(sizes)
                ids = np.insert(ids, stop, END)
                stop = stop + np.arange(1, len(stop) + 1)
                some = keys[lo : lo + len(sizes)].to_pylist()
                done = 0
                while done < len(some):
                    base = int(stop[done - 1]) if done else 0
                    upto = min(len(some), max(done + 1, int(np.searchsorted(stop, base + shard_tokens - total, "left")) + 1))
                    held.append(ids[base : stop[upto - 1]])
                    names += some[done:upto]
                    ends += (stop[done:upto] - base + total).tolist()
                    total, done = ends[-1], upto
                    if total >= shard_tokens:
                        yield close()
                        shard, before = shard + 1, before + total
                        held, names, ends, total = [], [], [], 0
        if names:
            yield close()

    order = ["doc_id", "head", "digest", "place"]
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_null(text).alias("text"))
        .withColumns({"head": F.substring("text", 1, HEAD), "digest": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    return materialise(rows.mapInArrow(written, _SHARDS), "shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the images."""
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = offsets.select(F.col("part").alias("o_part"), F.coalesce(F.sum("n").over(run), F.lit(0)).alias("offset"))
    # One row for each of the partitions that write_shards made; beyond a size, a shuffled join.
    placed = shards.join(small(offsets, BROADCAST_PARTS), F.col("part") == F.col("o_part"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = wavelet.WaveletFile(image.as_buffer().to_pybytes())
                ids = file.decode().astype("<u4")
                starts = np.concatenate([[0], file.ends[:-1]])
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), file.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, pa.int64()), pa.array(starts + first), pa.array(file.ends - starts), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.select((F.col("offset") + F.col("before")).alias("first"), "image").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def word_bpe() -> str:
    """Path of the public word BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, as read back from the shard files."""
    return read_documents(write_shards(table(spark, sf_dir, "documents"), word_bpe()))
