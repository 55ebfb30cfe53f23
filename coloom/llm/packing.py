"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

1. A document is its token ids and an end id.  Only documents of more than ``most`` ids
   are cut, into pieces of ``most``; the last piece may be shorter.  Everything else is
   one piece.  Token ids come from the library; words between ASCII white space are
   remembered, as they are tokenised alike wherever they stand.
2. The plan is made from how many pieces there are of each length, at most ``most``
   numbers however many documents there are.  Lengths are taken from the longest to the
   shortest; all pieces of a length go, a run of sequences at a time, to the sequences
   with the least room that still fits, and new sequences are opened for what is left.
   This is best fit, decreasing, of the single pieces, without going through them.
3. A line of the plan says that the pieces of a length with ranks from r on stand in the
   sequences from s on, one in each, at one offset.  The plan's size depends on the
   lengths alone, so every task has it and a piece finds its place by (length, rank).
4. A rank within a length is counted in each partition of the written pieces; the counts
   of the partitions before are added.  So pieces of one length, even if it is the length
   of most, are never in one task.

Sequences are gapless from offset 0.  Null texts are empty: the end id alone.  A null id is
kept.  Rows that are alike, also in id, are pieces of their own and take places of their own;
which of two equal pieces takes which place is settled when they are written.  Very long texts
become pieces, whole; a task holds one text at a time beside its batch.  An empty table gives
no rows.  Columns of ``docs`` other than id and text are ignored, whatever their names;
``place`` keeps every column of its input but ``_``-names of its own, which it refuses.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coloom.llm.common import raw, small_batches, table
from coloom.session import cut

#: Pieces of words a worker remembers.
REMEMBERED = 1 << 19
#: Bytes of texts in a batch, about, and pieces of documents in one that goes out.
BATCH, PIECES_OUT = 16 << 20, 1 << 14
# How the tokenizer file normalises and cuts.
NORMAL = ["NFC", "Replace", "Lowercase"]
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose normal form is their lower case, and the same cuts over them.
PLAIN = r"^[!-~À-ÖØ-öø-ÿ]+$"
PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1 ..  of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Ragged:
    """Lists of numbers: all of them, and where each list starts."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes = flat, sizes.astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def joined(self, items: np.ndarray, sizes: np.ndarray) -> Ragged:
        """The lists that ``items`` name, joined as many at a time as ``sizes`` says."""
        flat = self.flat[_runs(self.first[items], self.sizes[items])]
        total = np.concatenate([[0], np.cumsum(self.sizes[items])])
        ends = np.cumsum(sizes)
        return Ragged(flat, total[ends] - total[ends - sizes])


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of the texts, those of each text by number, and how many it has."""
    words = pc.ascii_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), sizes


class WordIds:
    """Token ids of texts, made for their different words.

    The tokenizer must take white space as a border that it drops, as those do whose
    pre-tokens hold none; then a word has the same ids wherever it stands.  Where the
    tokenizer cuts words as ``CUTS`` does, words of ``PLAIN`` letters are cut here and
    their pieces go to its model, unless remembered; all other words go to the library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        before = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        pattern = before[0].get("pattern", {}).get("Regex")
        self.cuts = normal == NORMAL and pattern == CUTS and before[-1]["type"] == "ByteLevel" and spec["model"]["type"] == "BPE"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        # Ids are kept as bytes, which the garbage collector does not visit.
        self.known: dict[str, bytes] = {"": b""}

    def of_text(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _of_piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _of_each(self, items: pa.Array, make) -> Ragged:
        known = self.known if make == self._of_piece else {}
        if len(known) > REMEMBERED:
            known.clear()
        found = []
        for item in items.to_pylist():
            ids = known.get(item)
            if ids is None:
                ids = known[item] = make(item)
            found.append(ids)
        return Ragged(np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4)

    def _of_words(self, words: pa.Array) -> Ragged:
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False) if self.cuts else np.zeros(len(words), bool)
        for token in self.special:
            plain &= ~pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        rest = self._of_each(words.filter(pa.array(~plain)), self.of_text)
        cut_up = pc.replace_substring_regex(pc.utf8_lower(words.filter(pa.array(plain))), PIECES, r"\1 ")
        pieces_, numbers, sizes = _split(cut_up)
        mine = self._of_each(pieces_, self._of_piece).joined(numbers, sizes)
        # Back into the order of the words.
        order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]), kind="stable")
        both = Ragged(np.concatenate([mine.flat, rest.flat]), np.concatenate([mine.sizes, rest.sizes]))
        return both.joined(order, np.ones(len(order), np.int64))

    def of_batch(self, texts: pa.Array) -> Ragged:
        """The ids of each text."""
        words, numbers, sizes = _split(pc.cast(texts, pa.string(), safe=False))
        return self._of_words(words).joined(numbers, sizes)


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """One for all tasks of a worker process, with what it remembers."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 2048, end: int = 0) -> DataFrame:
    """(id, piece, start, length, ids) of each piece; ids are little-endian unsigned 32-bit numbers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for batch in batches:
            for part in small_batches([batch], BATCH):
                found = words.of_batch(part.column("text"))
                flat = np.insert(found.flat, np.cumsum(found.sizes), end).astype("<u4")
                sizes = found.sizes + 1
                n = -(-sizes // most)
                own = np.repeat(np.arange(len(n)), n)
                piece = _runs(np.zeros(len(n), np.int64), n)
                length = np.minimum(most, sizes[own] - piece * most)
                first = np.cumsum(length) - length
                for at in range(0, len(own), PIECES_OUT):
                    some = slice(at, at + PIECES_OUT)
                    ends = np.concatenate([[0], 4 * np.cumsum(length[some])]).astype(np.int32)
                    data = flat[first[at] : first[at] + ends[-1] // 4].tobytes()
                    ids = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id").take(pa.array(own[some])),
                            pa.array(piece[some].astype(np.int32)),
                            pa.array(piece[some] * most),
                            pa.array(length[some].astype(np.int32)),
                            ids,
                        ],
                        ["id", "piece", "start", "length", "ids"],
                    )

    rows = docs.select(F.col(id_col).alias("id"), raw(text_col).alias("text"))
    return rows.mapInArrow(cut_up, f"id {kind}, piece int, start long, length int, ids binary")


def plan(counts: dict[int, int], most: int) -> tuple[np.ndarray, int]:
    """Lines (length, first rank, first sequence, offset), and how many sequences there are.

    The pieces of a line's length with ranks from its first up to that of the next line
    stand in consecutive sequences.
    """
    lines, opened = [], 0
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            first, n = runs[room].pop()
            if not runs[room]:
                del runs[room], rooms[at]
            took = min(left, n)
            lines.append((length, rank, first, most - room))
            leave(room, first + took, n - took)
            leave(room - length, first, took)
            left -= took
            rank += took
        if not left:
            continue
        each = most // length
        for n, per in ((left // each, each), (1, left % each)):
            if n and per:
                for k in range(per):
                    lines.append((length, rank, opened, k * length))
                    rank += n
                leave(most - per * length, opened, n)
                opened += n
    return np.array(lines, np.int64).reshape(-1, 4), opened


def place(rows: DataFrame, most: int = 2048) -> DataFrame:
    """``rows`` with (sequence_id, offset); ``length`` is 1 to ``most`` in each."""
    if taken := [c for c in rows.columns if c in ("_row", "_part", "_before", "_rank", "_at", "sequence_id", "offset")]:
        raise ValueError(f"columns named {taken} are in the way")
    part = F.shiftright("_row", 33).alias("_part")
    written = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    counts = written.groupBy("length", part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(counts.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lines, _ = plan(histogram, most)
    keys = lines[:, 0] << 48 | lines[:, 1]
    order = np.argsort(keys)
    sent = rows.sparkSession.sparkContext.broadcast((keys[order], lines[order]))

    @F.arrow_udf("struct<sequence_id: long, offset: int>")
    def slot(length: pa.Array, rank: pa.Array) -> pa.Array:
        starts, all_lines = sent.value
        rank = rank.to_numpy(zero_copy_only=False)
        line = all_lines[np.searchsorted(starts, length.to_numpy(zero_copy_only=False).astype(np.int64) << 48 | rank, "right") - 1]
        return pa.StructArray.from_arrays(
            [pa.array(line[:, 2] + rank - line[:, 1]), pa.array(line[:, 3].astype(np.int32))], ["sequence_id", "offset"]
        )

    within = Window.partitionBy("length", "_part").orderBy("_row")
    ranked = written.withColumn("_part", part).withColumn("_rank", (F.row_number().over(within) - 1).cast("long"))
    found = ranked.join(before.select("length", "_part", "_before"), ["length", "_part"])
    return found.withColumn("_at", slot("length", F.col("_rank") + F.col("_before"))).select(*rows.columns, "_at.*")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 2048, end: int = 0) -> DataFrame:
    """(id, piece, start, length, ids, sequence_id, offset) of each piece of ``docs``."""
    return place(pieces(docs, path, id_col, text_col, most, end), most)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, spans): the ids of each sequence, and the (offset, id, piece, start, length) they are made of."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "id", "piece", "start", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return whole.select(
        "sequence_id",
        F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"),
        F.transform("parts", lambda p: p.dropFields("ids")).alias("spans"),
    )


def op13_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut_up = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return place(cut_up.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))).select(
        F.col("id").alias("doc_id"),
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "sequence_id",
        F.col("offset").cast("long").alias("offset"),
    )
