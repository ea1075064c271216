"""Packing documents into fixed-length training sequences: shortest-pack-first over the length histogram.

Documents are tokenised and cut at multiples of the sequence length.  Whole pieces are sequences by
themselves.  The remainders are packed by their length histogram alone (at most ``LENGTH`` - 1 bins,
whatever the input): lengths are placed longest first, each into the packs with most room, and the
packs are kept as counted patterns, that is, as ranges of sequence ids with equal room.  The result,
rows (length, rank range, first sequence, offset), is joined back to documents by the rank of a
document among those of equal remainder.

Scale.  Text is tokenised once, and the tokens are reduced to a CRC per piece before anything is
shuffled.  Ranks are two-level (see ``running_before``), so a single length may hold any share of all
rows.  The placement table has a bounded size and is broadcast.

Edge cases.  Null and empty texts are one piece, the end token alone.  Rows are packed one by one, so
repeated rows and null ids are packed like any other.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import row_order, running_before, small_batches
from voxloom.session import checked_broadcast, durable

#: Tokens of a sequence, and the token that ends each document.
LENGTH, END = 4096, 2
TOKENIZER = "word_bpe_49k.json"
#: Words, and parts of words, whose tokens a Python worker remembers, in each of two generations.
REMEMBERED = 300_000

# --- tokens ------------------------------------------------------------------------------------

#: Characters that Python's str.split parts words at but the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Words that are cut here as the tokenizer cuts them: printable characters up to U+024F, where case folding
#: and composition are simple.  All others, and what may be a special token, go through the tokenizer whole.
_PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u024f]+")
# The tokenizer's published split pattern and normaliser, and the characters that stand for bytes.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_AS_CHARACTERS = {b: _HIDDEN.get(b, b) for b in range(256)}


class Memory(dict):
    """A function of words that remembers two generations of results, so that its size is bounded."""

    def __init__(self, function: Callable[[str], bytes]):
        super().__init__()
        self.function, self.older = function, {}

    def __missing__(self, word: str) -> bytes:
        value = self.older.get(word)
        if value is None:
            value = self.function(word)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, as the tokenizer gives them.

    White space always parts tokens and leaves none, so the ids of a text are those of its words in
    order; plain words are cut by the published pattern, and their parts are remembered too, since
    most new words differ from known ones by case and punctuation only.  A tokenizer of another
    normaliser or split pattern than the published ones gets every text whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.parts = Memory(self._word), Memory(self._part)
        with open(path, encoding="utf-8") as source:
            made = json.load(source)
        split = [p.get("pattern", {}).get("Regex") for p in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.published = made.get("normalizer") == _NORMALIZER and split[:1] == [_PARTS.pattern]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        visible = part.encode().decode("latin-1").translate(_AS_CHARACTERS)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(visible)])

    def _word(self, word: str) -> bytes:
        if "<|" in word or not _PLAIN.fullmatch(word):
            return self.whole(word)
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(word.lower())))

    def ids(self, text: str) -> bytes:
        if not self.published or _ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder; ``path`` is that of a tokenizer file."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path is None:
            import public_tokenizers

            _encoders[path] = Encoder(public_tokenizers.path(TOKENIZER))
        else:
            _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, rank, doc_tokens, crcs): the tokens of each row with the end token, and the CRC of each piece of ``length``."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    end, wide = np.array([END], "<u4").tobytes(), 4 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer_path)
        for batch in batches:
            tokens, crcs = [], []
            for text in batch.column(1):
                ids = known.ids(text.as_py() or "") + end
                tokens.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + wide]) for i in range(0, len(ids), wide)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "rank", "doc_tokens", "crcs"])

    return docs.select("doc_id", "text", row_order(F.col("doc_id"), F.col("text")).alias("rank")).mapInArrow(cut, f"doc_id {kind}, rank long, doc_tokens long, crcs array<long>")


# --- packs -------------------------------------------------------------------------------------


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, first sequence, offset), and the number of sequences.

    The documents of one length and of ranks first..end-1 go to as many sequences in a row, all at the same offset.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    packs: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of sequences
    rooms: list[int] = []  # a heap of the rooms in packs, largest first
    sequences = 0

    def put(room: int, start: int, end: int) -> None:
        if room:
            if room not in packs:
                packs[room] = []
                heapq.heappush(rooms, -room)
            packs[room].append((start, end))

    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        placed: list[tuple[int, int, int]] = []
        while left:
            while rooms and not packs.get(-rooms[0]):
                packs.pop(-heapq.heappop(rooms), None)
            room = -rooms[0] if rooms else 0
            if room >= size:
                start, end = packs[room].pop()
                n = min(left, end - start)
                if start + n < end:
                    packs[room].append((start + n, end))
            else:
                room, start, n = length, sequences, left
                sequences += n
            rows.append((size, rank, rank + n, start, length - room))
            placed.append((room - size, start, start + n))
            rank, left = rank + n, left - n
            # A pack just opened or refilled is the shortest only after all others of its room.
            for item in placed:
                put(*item)
            placed.clear()
    return rows, sequences


def pack(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of each row (doc_id, text)."""
    spark = docs.sparkSession
    tokens = durable(tokenized(docs, tokenizer_path, length))
    tokens = tokens.withColumn("rest", (F.col("doc_tokens") % length).cast("int")).withColumn("whole", F.floor(F.col("doc_tokens") / length))
    histogram = {r[0]: r[1] for r in tokens.groupBy("rest").count().collect()}  # at most ``length`` rows
    rows = sum(histogram.values())
    histogram.pop(0, None)
    placement, sequences = shortest_pack_first(histogram, length)
    # All rows' whole pieces come after the packs, numbered in the order of rank.
    tokens = running_before(tokens, [], "rank", ["doc_id", "doc_tokens"], {"whole_before": "whole"}, rows)
    tokens = durable(tokens.withColumn("one", F.lit(1)))
    ranked = running_before(tokens, ["rest"], "rank", ["doc_id", "doc_tokens"], {"rest_rank": "one"}, rows)
    place = checked_broadcast(spark.createDataFrame(placement, "p_rest int, p_first long, p_end long, p_sequence long, p_offset long"))
    ranked = ranked.join(place, (F.col("rest") == F.col("p_rest")) & F.col("rest_rank").between(F.col("p_first"), F.col("p_end") - 1), "left")
    pieces = ranked.select("*", F.posexplode("crcs").alias("piece", "crc"))
    whole = F.col("piece") < F.col("whole")
    return pieces.select(
        "doc_id",
        (F.col("piece") * F.lit(length)).cast("long").alias("start"),
        F.when(whole, F.lit(length)).otherwise(F.col("rest")).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        F.when(whole, F.lit(sequences) + F.col("whole_before") + F.col("piece")).otherwise(F.col("p_sequence") + F.col("rest_rank") - F.col("p_first")).cast("long").alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("p_offset")).cast("long").alias("offset"),
    )
