"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their log scores are read from a SentencePiece model file; nothing
is trained.  A file of merges scores a piece by minus its rank, which is no log
probability; those ranks are read as -log((1 + rank) * H) with H the sum of all
1 / (1 + rank), Zipf's law.  A text is encoded as follows:

1. Spaces become the marker U+2581 and one marker is put in front.
2. A text is cut before each run of markers, and around characters that are in no
   longer piece.  A piece holds markers only at its start (otherwise the text is
   not cut), so the best path of the text is the best paths of its chunks, one
   after the other.  New chunks of the same length are walked together.
3. A chunk's path has the largest sum of scores; on ties the longest last piece
   wins.  All pieces that start at a byte come from one walk through the trie.
4. A character without a piece costs the lowest score less 10 and is written as
   its bytes (or as the unknown piece, if the model has no byte pieces).

Decoding joins the pieces, turns byte pieces back into bytes and markers into
spaces, and takes the first space away.  A marker that is in the text itself is
written as bytes, as is a byte that is no UTF-8, so with byte pieces decoding gives
back every text exactly.

Null and empty texts have no ids.  Control pieces never come out of a text.  Every
row gives a row; repeated rows and extra columns make no difference.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coloom.llm.common import raw, small_batches, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁".encode()
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
#: Chunks of which a worker remembers the ids, about, and bytes of text encoded together.
REMEMBER = 300_000
TOGETHER = 3 << 20
#: Bytes of text whose rows are given out together where a whole batch need not stay.
AT_ONCE = 1 << 20
UNKNOWN_COST = 10.0


class DoubleArray:
    """A trie over bytes: the child of node s by byte c is t = base[s] + c + 1 if check[t] = s."""

    def __init__(self, words: dict[bytes, int]) -> None:
        children: dict[bytes, list[int]] = {}
        for w in words:
            for i in range(len(w)):
                children.setdefault(w[:i], []).append(w[i])
        used = bytearray(1 << 12)
        base, check, value = [0], [-1], [-1]
        used[0] = 1
        # Lone children fill the first gaps; the search for siblings starts where it last had to go far.
        single, several = 1, 1
        nodes, place = [b""], {b"": 0}
        for prefix in nodes:  # grows while it is read: breadth first
            kids = sorted(set(children.get(prefix, ())))
            s = place[prefix]
            value[s] = words.get(prefix, -1)
            if not kids:
                continue
            at, tries = max(single if len(kids) == 1 else several, kids[0] + 1), 0
            while True:
                at = used.find(0, at)
                if at < 0 or at + 257 > len(used):
                    at = len(used) - 257 if at < 0 else at
                    used.extend(bytes(len(used)))
                    continue
                shift = at - kids[0]
                if not any(used[shift + c] for c in kids):
                    break
                at, tries = at + 1, tries + 1
            if len(kids) == 1:
                single = max(used.find(0, single), 1)
            elif tries > 32:
                several = at
            base[s] = shift - 1
            for c in kids:
                t = shift + c
                used[t] = 1
                while len(base) <= t:
                    base.append(0), check.append(-1), value.append(-1)
                check[t] = s
                place[prefix + bytes([c])] = t
                nodes.append(prefix + bytes([c]))
        ends = [0] * (len(used) - len(base))
        self.base, self.check, self.value = base + ends, check + [-1] * len(ends), value + [-1] * len(ends)

    def prefixes(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, word) of all words that begin at ``start``, shortest first."""
        base, check, value = self.base, self.check, self.value
        s = 0
        for i in range(start, len(text)):
            t = base[s] + text[i] + 1
            if check[t] != s or t == 0:
                return
            s = t
            if value[s] >= 0:
                yield i + 1, value[s]


class Pieces:
    """Pieces, scores and kinds, in the order of their ids."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]) -> None:
        self.pieces, self.scores = [p.encode() for p in pieces], scores
        self.bytes: dict[int, int] = {}
        words: dict[bytes, int] = {}
        self.unknown = 0
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
            elif k == UNKNOWN:
                self.unknown = i
            elif k in (NORMAL, USER) and p:
                words.setdefault(p.encode(), i)
        self.trie = DoubleArray(words)
        self.lowest = min((scores[i] for i in words.values()), default=0.0)
        self.cuts = not any(MARKER in p.replace(MARKER, b"\x00").lstrip(b"\x00").replace(b"\x00", MARKER) for p in words)
        self.back = {i: bytes([b]) for b, i in self.bytes.items()}
        self.text = [
            self.back[i] if i in self.back else b"" if k not in (NORMAL, USER) else p.encode()
            for i, (p, k) in enumerate(zip(pieces, kinds, strict=True))
        ]
        self.known: dict[bytes, bytes] = {}
        self.arrays = (
            np.array(self.trie.base, np.int32),
            np.array(self.trie.check, np.int32),
            np.array(self.trie.value, np.int32),
            np.array(scores),
        )
        # An ASCII character that is in no longer piece is a chunk of its own.
        alone = {bytes([c]) for c in range(128)} - {bytes([c]) for p in words if len(p) > 1 for c in p}
        lone = b"".join(b"\\x%02x" % c for (c,) in alone)
        free = b"[^%b]" % lone if lone else b"[\x00-\xff]"
        more = b"|[%b]" % lone if lone else b""
        self.pattern = re.compile(b"(?s)(?:%b)+(?:(?!%b)%b)*|(?:(?!%b)%b)+%b" % (MARKER, MARKER, free, MARKER, free, more))

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        kind = [BYTE if m.is_byte(i) else UNKNOWN if m.is_unknown(i) else 0 if m.is_control(i) or m.is_unused(i) else NORMAL for i in ids]
        scores = [m.get_score(i) for i in ids]
        if all(s == int(s) <= 0 for s in scores):  # ranks
            whole = np.log(sum(1 / (1 - s) for s, k in zip(scores, kind, strict=True) if k == NORMAL))
            scores = [-float(np.log1p(-s) + whole) for s in scores]
        return cls([m.id_to_piece(i) for i in ids], scores, kind)

    def viterbi(self, chunk: bytes) -> list[int]:
        """The ids of the path with the largest sum of scores."""
        n = len(chunk)
        best, back, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        scores, lost = self.scores, self.lowest - UNKNOWN_COST
        for start in range(n):
            here = best[start]
            if here == -np.inf:
                continue
            width = _width(chunk, start)
            single = False
            for end, word in self.trie.prefixes(chunk, start):
                single |= end == start + width
                if here + scores[word] > best[end]:
                    best[end], back[end], piece[end] = here + scores[word], start, word
            if not single and here + lost > best[start + width]:
                best[start + width], back[start + width], piece[start + width] = here + lost, start, -1
        out: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out.extend(reversed(self.spelt(chunk[back[at] : at])))
            at = back[at]
        return out[::-1]

    def viterbi_many(self, chunks: list[bytes]) -> list[list[int]]:
        """``viterbi`` of many chunks, those of one length together, step by step."""
        out: list[list[int]] = [[] for _ in chunks]
        by_size: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            if len(c) > 64:
                out[i] = self.viterbi(c)
            elif c:
                by_size.setdefault(len(c), []).append(i)
        for n, every in by_size.items():
            for at in range(0, len(every), 20_000):
                some = every[at : at + 20_000]
                text = np.frombuffer(b"".join([chunks[i] for i in some]), np.uint8).reshape(-1, n).astype(np.int32)
                back, piece = self._paths(text, [chunks[i] for i in some])
                for i, b, p in zip(some, back.tolist(), piece.tolist(), strict=True):
                    path, end = [], n
                    while end:
                        if p[end] >= 0:
                            path.append(p[end])
                        else:
                            path.extend(reversed(self.spelt(chunks[i][b[end] : end])))
                        end = b[end]
                    out[i] = path[::-1]
        return out

    def _paths(self, text: np.ndarray, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the last piece of the best path to each byte begins, and the piece (-1: none)."""
        rows, n = text.shape
        base, check, value, scores = self.arrays
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((rows, n + 1), np.int32), np.full((rows, n + 1), -1, np.int32)
        plain = (text < 0x80).all()
        for start in range(n):
            alive = np.flatnonzero(best[:, start] > -np.inf)
            width = np.ones(rows, np.int64)
            if not plain:
                for i in alive[text[alive, start] >= 0x80].tolist():
                    width[i] = _width(chunks[i], start)
            lone = np.ones(rows, bool)  # no piece for the single character
            reached, node = alive, np.zeros(len(alive), np.int32)
            for end in range(start + 1, n + 1):
                child = base[node] + text[alive, end - 1] + 1
                ok = check[child] == node
                alive, node = alive[ok], child[ok]
                if not len(alive):
                    break
                word = value[node]
                here, word = alive[word >= 0], word[word >= 0]
                lone[here[width[here] == end - start]] = False
                total = best[here, start] + scores[word]
                better = total > best[here, end]
                here = here[better]
                best[here, end], back[here, end], piece[here, end] = total[better], start, word[better]
            lost = reached[lone[reached]]
            ends = start + width[lost]
            total = best[lost, start] + (self.lowest - UNKNOWN_COST)
            better = total > best[lost, ends]
            lost, ends = lost[better], ends[better]
            best[lost, ends], back[lost, ends], piece[lost, ends] = total[better], start, -1
        return back, piece

    def spelt(self, char: bytes) -> list[int]:
        return [self.bytes[b] for b in char] if self.bytes else [self.unknown]

    def chunks(self, text: bytes) -> list[bytes]:
        """The parts that are encoded on their own; an empty one for a marker that the text itself holds."""
        if MARKER in text:
            out: list[bytes] = []
            for i, part in enumerate(text.split(MARKER)):
                out += ([b""] if i else []) + self._cut((part if i else b" " + part).replace(b" ", MARKER))
            return out
        return self._cut((b" " + text).replace(b" ", MARKER))

    def _cut(self, marked: bytes) -> list[bytes]:
        return self.pattern.findall(marked) if self.cuts else [marked] if marked else []

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as packed 32-bit numbers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, first = 0, at
            while at < len(texts) and (at == first or size + len(texts[at]) <= TOGETHER):
                size += len(texts[at])
                at += 1
            cut = [self.chunks(t) if t else [] for t in texts[first:at]]
            known = self.known if len(self.known) < REMEMBER else {}
            self.known = known
            fresh = list({c for chunks in cut for c in chunks if c not in known})
            paths = self.viterbi_many(fresh)
            known.update((c, np.array(p, "<i4").tobytes()) for c, p in zip(fresh, paths, strict=True))
            known[b""] = np.array(self.spelt(MARKER), "<i4").tobytes()
            out += [b"".join([known[c] for c in chunks]) for chunks in cut]
        return out

    def encode(self, text: bytes) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        """The text of the ids, without the space in front."""
        spelt, text = self.back, self.text
        if not any(map(spelt.__contains__, ids)):
            out = b"".join([text[i] for i in ids]).replace(MARKER, b" ")
        else:  # bytes are no markers, whatever they spell
            out = b"".join([text[i] if i in spelt else text[i].replace(MARKER, b" ") for i in ids])
        return out[1:] if out[:1] == b" " else out


def _width(text: bytes, at: int) -> int:
    """Bytes of the character at ``at``; 1 if it is no UTF-8."""
    first = text[at]
    n = 1 if first < 0xC2 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4 if first < 0xF5 else 1
    tail = text[at + 1 : at + n]
    return n if len(tail) == n - 1 and all(0x80 <= b < 0xC0 for b in tail) else 1


def _model(spark, path: str):
    """The pieces, read once by the driver and broadcast; a model file has a fixed size."""
    return spark.sparkContext.broadcast(Pieces.load(path))


def encode_column(spark, text_col: str, path: str = VOCABULARY) -> Column:
    """The ids of a text."""
    model = _model(spark, path)

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        packed = model.value.encode_many(texts.to_pylist())
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    return of(raw(text_col))


def decode_column(spark, ids: Column, path: str = VOCABULARY) -> Column:
    """The text of an array of ids, as bytes; no ids give no bytes."""
    model = _model(spark, path)

    @F.arrow_udf("binary")
    def of(rows: pa.Array) -> pa.Array:
        flat, ends = rows.flatten().to_numpy(), rows.offsets.to_numpy()
        ends = ends - ends[0]
        texts = [model.value.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.array(texts, pa.binary())

    return of(F.coalesce(ids, F.array().cast("array<int>")))


def both_column(spark, text_col: str, path: str = VOCABULARY) -> Column:
    """struct(ids, text): the ids of a text and, as bytes, what they decode to, from one worker."""
    model = _model(spark, path)

    @F.arrow_udf("struct<ids: array<int>, text: binary>")
    def of(texts: pa.Array) -> pa.Array:
        packed, decoded = [], []
        for some in small_batches(iter([pa.record_batch([texts], ["text"])]), TOGETHER):
            for ids in model.value.encode_many(some.column(0).to_pylist()):
                packed.append(ids)
                decoded.append(model.value.decode(np.frombuffer(ids, "<i4").tolist()))
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        return pa.StructArray.from_arrays([ids, pa.array(decoded, pa.binary())], ["ids", "text"])

    return of(raw(text_col))


def in_pieces(spark, docs: DataFrame, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``text_col`` as what its ids decode to, in bytes, and with ``ids``.

    Rows come out some ``AT_ONCE`` bytes of text at a time, so a worker never holds the ids and
    texts of a whole Arrow batch.  A text is worked on as it stands in a row of its own operator,
    whatever expression it comes from.
    """
    model = _model(spark, path)
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("own"), raw(text_col).alias("text"))
    out = "own " + rows.schema["own"].dataType.simpleString() + ", ids array<int>, text binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in small_batches(batches, AT_ONCE):
            packed = model.value.encode_many(some.column("text").to_pylist())
            decoded = [model.value.decode(np.frombuffer(p, "<i4").tolist()) for p in packed]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([some.column("own"), ids, pa.array(decoded, pa.binary())], ["own", "ids", "text"])

    return rows.mapInArrow(run, out).select("own.*", "ids", F.col("text").alias(text_col))


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", raw("text").alias("raw"), both_column(spark, "text").alias("b"))
    return docs.select(
        "doc_id",
        F.size("b.ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join("b.ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("b.text", 256).alias("decoded_sha256"),
        (F.col("b.text") == F.col("raw")).alias("round_trip"),
    )
