"""SentencePiece encoding and decoding by a shared-prefix forward search.

A text is cut into marked words: after each space (written U+2581) or line break a new
one begins, and no piece of the vocabulary reaches over such a cut. The distinct words
of a batch are sorted, so walking them in order is a depth-first walk of their trie:
the forward states of the prefix shared with the word before are kept, and only the
rest is searched.

Unigram models: the forward state of a prefix is its best total score (Viterbi) and where
the last piece of that segmentation starts. A character that no piece covers is an unknown
piece, 10 below the lowest score.

The vocabularies at hand are merge-ordered (BPE), where the segmentation of highest
total score is not the right one. There the forward state of a prefix is the last
piece of the prefix's own segmentation. A piece ending there is right exactly if the
merges of it and the piece before, taken alone, give these two pieces again; at every
place one piece passes. So states depend on the prefix only, as with Viterbi scores,
and results are those of the reference encoder. Words with runs of spaces, whose merges
have equal scores, are merged one by one.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import math
import struct
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm import arrowtext as at
from kinelake.llm.common import Shared, give_way, table

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Words (twice as many at most), and neighbouring pieces, remembered by a worker process.
KNOWN_WORDS, KNOWN_PAIRS = 150_000, 500_000
#: Bytes of text encoded at once.
BATCH_BYTES = 1 << 20
# Piece types and model types of the file format, and how far an unknown character is below the lowest score.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; values are ints or bytes."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 5:
            yield tag >> 3, data[i : i + 4]
            i += 4
        elif kind == 1:
            yield tag >> 3, data[i : i + 8]
            i += 8
        else:
            n = varint()
            yield tag >> 3, data[i : i + n]
            i += n


class Model:
    """Vocabulary of a SentencePiece model file (unigram or BPE, no normalisation, dummy prefix).

    Other kinds of model raise ValueError.
    """

    def __init__(self, data: bytes):
        self.mark = hashlib.sha256(data).hexdigest()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, _NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                kinds.append(kind)
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) not in (_UNIGRAM, _BPE) or normalizer.get(2) or _USER in kinds or _UNUSED in kinds:
            raise ValueError("only unigram and BPE models without normalisation map and user-defined pieces are supported")
        if not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models with a dummy prefix, escaped and unchanged spaces are supported")
        self.unknown = kinds.index(_UNKNOWN)
        self.bytes_ = [-1] * 256
        for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)):
            if k == _BYTE:
                self.bytes_[int(p[3:5], 16)] = i
        self.normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.normal) or any("\n" in p for p in self.normal):
            raise ValueError("pieces over several words are not supported")
        self.longest = max(map(len, self.normal), default=1)
        self.unigram = trainer.get(3, 1) == _UNIGRAM
        self.worst = min((self.scores[i] for i in self.normal.values()), default=0.0) - UNKNOWN_PENALTY
        # Pieces that their own merges can make; others never occur.
        self.made = {p: i for p, i in self.normal.items() if self.unigram or len(p) == 1 or self.merge(p) == [p]}
        surface = [b""] * len(self.pieces)
        for p, i in self.normal.items():
            surface[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes_):
            if i >= 0:
                surface[i] = bytes([b])
        surface[self.unknown] = " ⁇ ".encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_start = np.concatenate([[0], np.cumsum([len(x) for x in surface])])

    def merge(self, word: str) -> list[str]:
        """Pieces and single characters left when no two neighbours make a piece: best score first, then leftmost."""
        n = len(word)
        end = list(range(1, n + 1))  # of the symbol that starts here; 0 once merged into another
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list = []

        def offer(i: int, j: int) -> None:
            piece = self.normal.get(word[i : end[j]])
            if piece is not None:
                heapq.heappush(heap, (-self.scores[piece], i, j, end[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not end[i] or not end[j] or after[i] != j or end[j] != stop or end[i] != j:
                continue
            end[i], end[j] = stop, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [word[i : end[i]] for i in range(n) if end[i]]

    def ids_of_character(self, character: str) -> list[int]:
        raw = [self.bytes_[b] for b in character.encode("utf-8", "replace")]
        return [self.unknown] if min(raw) < 0 else raw

    def ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.normal.get(p)
            out.extend([i] if i is not None else self.ids_of_character(p))
        return out


class Encoder:
    """Encodes distinct marked words; remembers which two pieces may stand side by side."""

    def __init__(self, model: Model):
        self.model = model
        self.together: dict[int, bool] = {}

    def _fit(self, a: int, b: int) -> bool:
        """Whether the merges of pieces a and b, taken alone, give these two again."""
        key = a * len(self.model.pieces) + b
        fits = self.together.get(key)
        if fits is None:
            if len(self.together) > KNOWN_PAIRS:
                self.together.clear()
            x, y = self.model.pieces[a], self.model.pieces[b]
            fits = self.together[key] = self.model.merge(x + y) == [x, y]
        return fits

    def encode_sorted(self, words: list[str]) -> list[bytes]:
        """Piece ids of each word, as the bytes of int32; words ascend, so that shared prefixes follow each other."""
        if self.model.unigram:
            return self._viterbi(words)
        model, made, longest = self.model, self.model.made, self.model.longest
        together, n_pieces = self.together, len(model.pieces)
        last = [-1]  # by prefix length: the last piece of its segmentation, -1 for a single unknown character
        back = [0]  # and where that piece starts
        previous, out = "", []
        for word in words:
            if word.startswith(MARK + MARK):
                out.append(array.array("i", model.ids(model.merge(word))).tobytes())
                continue
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del last[shared + 1 :], back[shared + 1 :]
            previous = word
            for end in range(shared + 1, len(word) + 1):
                # One piece ends here in the prefix's segmentation; it is most often a short one.
                for start in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                    piece = made.get(word[start:end])
                    if piece is None:
                        continue
                    left = last[start]
                    if left < 0:
                        break
                    fits = together.get(left * n_pieces + piece)
                    if fits or (fits is None and self._fit(left, piece)):
                        break
                else:
                    piece, start = -1, end - 1
                last.append(piece)
                back.append(start)
            found, end = [], len(word)
            while end:
                start = back[end]
                if last[end] >= 0:
                    found.append(last[end])
                else:
                    found.extend(reversed(model.ids_of_character(word[start])))
                end = start
            found.reverse()
            out.append(array.array("i", found).tobytes())
        return out


    def _viterbi(self, words: list[str]) -> list[bytes]:
        """The same by the highest total score; of equal ones the last piece is the longest."""
        model, longest = self.model, self.model.longest
        normal, scores, worst = model.normal, model.scores, model.worst
        best = [0.0]  # by prefix length: the highest total score
        back, last = [0], [-1]  # where its last piece starts, and the piece (-1: an unknown character)
        previous, out = "", []
        for word in words:
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :], last[shared + 1 :]
            previous = word
            for end in range(shared + 1, len(word) + 1):
                top, place, piece = -math.inf, end - 1, -1
                for start in range(max(0, end - longest), end):
                    i = normal.get(word[start:end])
                    if i is not None and best[start] + scores[i] > top:
                        top, place, piece = best[start] + scores[i], start, i
                if word[end - 1] not in normal and best[end - 1] + worst > top:
                    top, place, piece = best[end - 1] + worst, end - 1, -1
                best.append(top)
                back.append(place)
                last.append(piece)
            found, end = [], len(word)
            while end:
                if last[end] >= 0:
                    found.append(last[end])
                    end = back[end]
                    continue
                stop = end  # neighbouring unknown characters are one piece
                while end and last[end] < 0:
                    end = back[end]
                raw = [model.bytes_[b] for b in word[end:stop].encode("utf-8", "replace")]
                found.extend([model.unknown] if min(raw) < 0 else reversed(raw))
            found.reverse()
            out.append(array.array("i", found).tobytes())
        return out


def marked_words(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The marked words of all texts, and the bounds of each text's. An empty text has none."""
    if pc.any(pc.match_substring(array, MARK)).as_py():
        array = pc.replace_substring(array, MARK, " ")
    broken = pc.replace_substring(array, "\n", " \n")  # a piece that starts with a line break has no space before it
    lists = pc.split_pattern(broken, " ")
    parts, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    empty_text = pc.equal(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    blank = pc.equal(pc.binary_length(parts), 0).to_numpy(zero_copy_only=False)
    line = pc.starts_with(parts, "\n").to_numpy(zero_copy_only=False)
    first = np.zeros(len(parts), bool)
    first[bounds[:-1]] = True
    # A first piece that starts with a line break: the inserted space leaves a blank before it, which is the dummy prefix.
    count, row = np.diff(bounds), at.row_of(bounds)
    marked = pc.if_else(pa.array(line), parts, pc.binary_join_element_wise(pa.scalar(MARK), parts, ""))
    if not blank.any():
        return marked, bounds
    # Runs of blanks join the word after them; a run before a line break or the end stands alone.
    keep = ~blank
    run_end = np.flatnonzero(blank & np.append((~blank[1:]) | first[1:], True))
    run_start = np.flatnonzero(blank & np.concatenate([[True], (~blank[:-1])]) | (blank & first))
    values = {}
    for a, b in zip(run_start.tolist(), run_end.tolist(), strict=True):
        if empty_text[row[b]]:
            continue
        size, follows = b - a + 1, b + 1
        if follows < len(parts) and not first[follows] and not line[follows]:
            values[follows] = MARK * (size + 1) + parts[follows].as_py()
        else:
            keep[b] = True
            values[b] = MARK * size
    if values:
        places = np.array(sorted(values))
        mask = np.zeros(len(parts), bool)
        mask[places] = True
        marked = pc.replace_with_mask(marked, pa.array(mask), pa.array([values[p] for p in places.tolist()], pa.string()))
    before = np.concatenate([[0], np.cumsum(keep)])
    del count
    return marked.filter(pa.array(keep)), before[bounds]


class Memory:
    """Ids of words met lately: a dictionary that fills up, and the one filled before it."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, words: list[str], encoder: Encoder) -> list[bytes]:
        young, old = self.young, self.old
        fresh = sorted(w for w in words if w not in young and w not in old)
        made = dict(zip(fresh, encoder.encode_sorted(fresh), strict=True))
        each = []
        for w in words:
            found = young.get(w)
            if found is None:
                found = made.get(w)
                young[w] = found = old[w] if found is None else found
            each.append(found)
        if len(young) > KNOWN_WORDS:
            self.young, self.old = {}, young
        return each


def encode_batch(texts: pa.Array, encoder: Encoder, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and the bounds of each text's."""
    found, bounds = marked_words(texts)
    codes, values = at.coded(found)
    each = memory.ids(values.to_numpy(zero_copy_only=False).tolist(), encoder)
    size = np.fromiter(map(len, each), np.int64, len(each)) // 4
    flat = np.frombuffer(b"".join(each), np.int32)
    start = np.cumsum(size) - size
    many = size[codes] if len(codes) else np.zeros(0, np.int64)
    edge = np.concatenate([[0], np.cumsum(many)])
    place = np.repeat(start[codes] - edge[:-1], many) + np.arange(edge[-1]) if len(codes) else np.zeros(0, np.int64)
    ids, ends = flat[place], edge[bounds]
    if min(encoder.model.bytes_) < 0 and len(ids) > 1:  # neighbouring unknown characters are one piece, across words too
        again = np.concatenate([[False], (ids[1:] == encoder.model.unknown) & (ids[:-1] == encoder.model.unknown)])
        again[ends[:-1][ends[:-1] < len(ids)]] = False
        ids, ends = ids[~again], ends - np.concatenate([[0], np.cumsum(again)])[ends]
    return ids, ends


def decode_batch(ids: np.ndarray, bounds: np.ndarray, model: Model) -> pa.Array:
    """Texts of the ids; a byte sequence that isn't UTF-8 gives replacement characters."""
    size = (model.surface_start[1:] - model.surface_start[:-1])[ids] if len(ids) else np.zeros(0, np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(model.surface_start[ids] - edge[:-1], size) + np.arange(edge[-1]) if len(ids) else np.zeros(0, np.int64)
    raw, offsets = model.surface[place], edge[bounds]
    # The dummy prefix: one space at the start of each text.
    some = np.flatnonzero(np.diff(offsets) > 0)
    lead = offsets[some][raw[offsets[some]] == 32]
    if len(lead):
        keep = np.ones(len(raw), bool)
        keep[lead] = False
        before = np.concatenate([[0], np.cumsum(keep)])
        raw, offsets = raw[keep], before[offsets]
    try:
        array = at.strings(raw, offsets)
        array.validate(full=True)
        return array
    except pa.ArrowInvalid:
        whole = raw.tobytes()
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())


def load(spark, path: str = MODEL_PATH) -> Model:
    """The model at `path` (of fixed size, a few MB at most): a file of the driver, or a URL that Spark reads."""
    if "://" in path:
        return Model(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, model: Model, text: str = "text", check: bool = False) -> DataFrame:
    """docs with ids (array of int) and n_ids; with check also round_trip: whether the ids decode to the text.

    A NULL text is encoded like an empty one: no ids. U+2581 in a text is encoded as a
    space, which is what it decodes to. Repeated rows are each encoded, an empty table stays
    empty, very long texts are encoded whole. Columns of docs named like the added ones give
    way; all others keep their values.
    """
    docs = give_way(docs, "ids", "n_ids", *(["round_trip"] if check else []))
    shared = Shared(docs.sparkSession, model)
    rest, name = docs.columns, f"_encoder_{model.mark}"

    def run(batches):
        model = shared.value
        if name not in sys.modules:  # a worker process runs many tasks; what it has learnt stays with it
            kept = sys.modules[name] = types.ModuleType(name)
            kept.encoder, kept.memory = Encoder(model), Memory()
        encoder, memory = sys.modules[name].encoder, sys.modules[name].memory
        for batch in at.slices(batches, text, BATCH_BYTES):
            array = at.texts(batch.column(text))
            ids, bounds = encode_batch(array, encoder, memory)
            out = [pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids)), pa.array(np.diff(bounds))]
            names = [*rest, "ids", "n_ids"]
            if check:
                out.append(pc.equal(decode_batch(ids, bounds, model), array))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *out], names)

    extra = {"ids": F.lit(None).cast("array<int>"), "n_ids": F.lit(0).cast("long")} | ({"round_trip": F.lit(True)} if check else {})
    return docs.mapInArrow(run, docs.withColumns(extra).schema)


def decode(df: DataFrame, model: Model, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of its ids; NULL ids give an empty text."""
    df = give_way(df, out) if out != ids else df
    shared = Shared(df.sparkSession, model)
    rest = df.columns

    def run(batches):
        model = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                lists = pc.fill_null(batch.column(ids), [])
                bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
                texts = decode_batch(lists.flatten().to_numpy().astype(np.int64), bounds, model)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), texts], [*rest, out])

    return df.mapInArrow(run, df.withColumn(out, F.lit("")).schema)


def query(spark, sf_dir):
    """Piece ids of every document: doc_id, n_ids, ids, round_trip (ids decode to the text)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, load(spark), check=True).select("doc_id", "n_ids", "ids", "round_trip")


QUERY = ("op4_sentencepiece", query)
