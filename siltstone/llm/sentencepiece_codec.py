"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

The pieces of a model and their scores are read as a unigram lattice: a text is cut into the pieces whose
scores add up to the most, ties going, at every end, to the longest last piece, which is the library's rule.
A character that no piece covers costs the least score less 10 and is spelt in byte pieces.

A run of texts is cut into its distinct chunks (between two bytes that stand together in no piece), and chunks of
equal length advance together: hashes of all their substrings probe the sorted hashes of the pieces, and a maximum
over the last piece's length gives each position's score and back-pointer for all of them at once.

The model type decides how the library itself would encode: a unigram model gives the ids below, a BPE model
merges by rank and may cut some words otherwise.  Decoding is the same for both, and exact: a text comes back
whole unless it holds the piece mark U+2581 itself, which reads as a space.

A null or empty text has no ids; no ids decode to an empty text, null ids to null.  A text of any length is
encoded whole, rows that repeat each by themselves, and an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import chunks as C
from siltstone.llm import kernel as K
from siltstone.llm.shared import batched

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
_NEVER = -1e300
_SEGMENT = 4096
#: Code points that advance together, in texts of equal length.
_POINTS = 100_000


@dataclass
class Vocabulary:
    """What a model holds: by id its text, score and kind (n piece, b byte, c control, u unknown)."""

    pieces: list[str]
    scores: np.ndarray
    kinds: str

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.vocab_size())
        kind = lambda i: "u" if m.is_unknown(i) else "b" if m.is_byte(i) else "c" if m.is_control(i) or m.is_unused(i) else "n"
        vocab = cls([m.id_to_piece(i) for i in ids], np.array([m.get_score(i) for i in ids], np.float64), "".join(map(kind, ids)))
        vocab._keys, vocab.gains, vocab.joined, vocab.piece_bytes  # noqa: B018  made once, and sent to the tasks with the rest
        return vocab

    @cached_property
    def normal(self) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k == "n"]

    @cached_property
    def unknown_score(self) -> float:
        return float(self.scores[self.normal].min()) - 10

    @cached_property
    def unknown_id(self) -> int:
        return self.kinds.index("u")

    @cached_property
    def byte_ids(self) -> np.ndarray | None:
        found = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == "b"}
        return np.array([found[b] for b in range(256)]) if len(found) == 256 else None

    @cached_property
    def longest(self) -> int:
        return max(len(self.pieces[i]) for i in self.normal)

    @cached_property
    def _keys(self):
        """Piece hashes ascending with their ids, and a bitmap of their low bits."""
        text = {}
        for i in self.normal:
            text.setdefault(len(self.pieces[i]), []).append(i)
        h = np.concatenate([_chained(np.frombuffer("".join(self.pieces[i] for i in ids).encode("utf-32-le"), np.uint32).reshape(len(ids), size)) for size, ids in text.items()])
        order = np.argsort(h)
        seen = np.zeros(1 << 20, bool)
        seen[(h & K.U((1 << 20) - 1)).astype(np.int64)] = True
        return h[order], np.concatenate(list(text.values()))[order].astype(np.int32), seen

    @cached_property
    def gains(self) -> np.ndarray:
        """By id its score, then what a character costs that no piece covers, and at the end what never happens."""
        return np.append(self.scores, [self.unknown_score, _NEVER])

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, or -1."""
        keys, ids, seen = self._keys
        out = np.full(h.shape, -1, np.int32)
        at = np.nonzero(seen[(h & K.U((1 << 20) - 1)).astype(np.int64)])
        found = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        out[at] = np.where(keys[found] == h[at], ids[found], -1)
        return out

    @cached_property
    def joined(self) -> np.ndarray:
        """By 256 * byte + next byte, whether some piece holds both; bytes of one code point always go together."""
        out = np.zeros((256, 256), bool)
        out[:, 0x80:0xC0] = True
        # A mark stands for itself and for a space.
        last = lambda c: (32, 0x81) if ord(c) == MARK else (c.encode()[-1],)
        first = lambda c: (32, 0xE2) if ord(c) == MARK else (c.encode()[0],)
        for a, b in {pair for i in self.normal for pair in zip(self.pieces[i], self.pieces[i][1:], strict=False)}:
            out[np.ix_(last(a), first(b))] = True
        return out.ravel()

    @cached_property
    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """By id the bytes it decodes to, flat, and their offsets."""
        parts = []
        for p, k in zip(self.pieces, self.kinds, strict=True):
            parts.append(bytes([int(p[3:5], 16)]) if k == "b" else p.replace(chr(MARK), " ").encode() if k == "n" else " ⁇ ".encode() if k == "u" else b"")
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _point_hashes(points: np.ndarray) -> np.ndarray:
    return K.mix(points.astype(K.U) + K.U(0x51ED27))


def _longer(h: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Hashes of substrings with one more point, from those without it."""
    return K.mix(h * K.U(0x9E3779B97F4A7C15) + point)


def _chained(points: np.ndarray) -> np.ndarray:
    """A hash of each row of code points."""
    h = np.zeros(len(points), K.U)
    for point in _point_hashes(points).T:
        h = _longer(h, point)
    return h


def _viterbi(vocab: Vocabulary, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of equal length, by end: the chosen last piece and its length."""
    n, length = points.shape
    most = min(vocab.longest, length)
    gains, unknown = vocab.gains, len(vocab.scores)
    best = np.full((n, most + length + 1), _NEVER)
    best[:, most] = 0
    piece, size = np.empty((n, length), np.int32), np.empty((n, length), np.int16)
    rows = np.arange(n)
    for a in range(0, length, _SEGMENT):
        b = min(length, a + _SEGMENT)
        ids = np.full((n, b - a, most), -1, np.int32)  # by end, longest first
        start = max(0, a + 1 - most)
        point = _point_hashes(points[:, start:b])
        h = np.zeros(point.shape, K.U)
        for k in range(1, most + 1):
            wide = b - start - k + 1
            if wide <= 0:
                break
            h = _longer(h[:, :wide], point[:, k - 1 :])
            lo = max(start, a + 1 - k)
            ids[:, lo + k - 1 - a :, most - k] = vocab.probe(h[:, lo - start :])
        last = ids[:, :, -1]
        last[last < 0] = unknown
        for e in range(a, b):
            reach = best[:, e + 1 : e + 1 + most] + gains[ids[:, e - a]]
            k = reach.argmax(1)
            best[:, most + e + 1] = reach[rows, k]
            size[:, e] = most - k
            piece[:, e] = ids[rows, e - a, k]
    piece[piece == unknown] = -1
    return piece, size


def _utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points, flat, and their number for each."""
    text = points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(text, np.uint8)
    start = np.flatnonzero((raw & 0xC0) != 0x80)
    return raw, np.diff(np.append(start, len(raw)))


def encode_chunks(vocab: Vocabulary, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the chunks that lie end to end in `raw`, and the number of ids of each."""
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    points[points == 32] = MARK
    at = K.code_points(np.frombuffer(raw, np.uint8))[np.concatenate([[0], np.cumsum(sizes)])]
    length = np.diff(at)
    who, last, piece, point = [], [], [], []
    for size in np.unique(length):
        group = np.flatnonzero(length == size)
        for part in np.array_split(group, -(-len(group) * int(size) // _POINTS)):
            text = points[at[part][:, None] + np.arange(size)]
            ids, cut = _viterbi(vocab, text)
            end, rows = np.full(len(part), size), np.arange(len(part))
            while len(rows):
                e = end[rows] - 1
                who.append(part[rows])
                last.append(e)
                piece.append(ids[rows, e])
                point.append(text[rows, e])
                end[rows] = e + 1 - cut[rows, e]
                rows = rows[end[rows] > 0]
    if not who:
        return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
    who, last, piece, point = map(np.concatenate, (who, last, piece, point))
    order = np.lexsort((last, who))
    who, piece, point = who[order], piece[order], point[order]
    odd = np.flatnonzero(piece < 0)
    if vocab.byte_ids is None or not len(odd):
        piece[odd] = vocab.unknown_id
        return piece, np.bincount(who, minlength=len(sizes))
    spelt, count = _utf8(point[odd])
    times = np.ones(len(piece), np.int64)
    times[odd] = count
    out = np.repeat(piece, times)
    out[out < 0] = vocab.byte_ids[spelt]
    return out, np.bincount(np.repeat(who, times), minlength=len(sizes))


def encode_block(vocab: Vocabulary, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a run of texts, flat, and their offsets."""
    buf, offs = C.spaced(buf, offs)
    starts, ends, first = C.chunks(buf, offs, vocab.joined)
    sample, number = C.unique(buf, starts, ends)
    size = ends[sample] - starts[sample]
    take, _ = C.spread(size, np.arange(len(size)))
    take += np.repeat(starts[sample] - (np.cumsum(size) - size), size) if len(size) else 0
    ids, count = encode_chunks(vocab, buf[take].tobytes(), size)
    values, at = C.spread(count, number)
    return ids[values], at[first]


def decode_block(vocab: Vocabulary, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts of a run of id lists, flat, and their offsets; the space put before a text goes."""
    flat, at = vocab.piece_bytes
    values, ends = C.spread(np.diff(at), ids)
    out, offs = flat[values], ends[offs]
    first = offs[:-1][np.diff(offs) > 0]
    first = first[out[first] == 32]
    keep = np.ones(len(out), bool)
    keep[first] = False
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def _encode(vocab: Vocabulary):
    def run(batches):
        for rows, buf, offs in K.blocks(batches, limit=C.BLOCK_BYTES):
            ids, at = encode_block(vocab, buf, offs)
            back, ends = decode_block(vocab, ids, at)
            same = np.array([np.array_equal(buf[a:b], back[c:d]) for a, b, c, d in zip(offs[:-1], offs[1:], ends[:-1], ends[1:], strict=True)], bool)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("doc_id")), pa.array(np.diff(at)), K.lists(pa.array(ids.astype(np.int32)), at), pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"]
            )

    return run


def encoded(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, and whether the ids decode to the very text."""
    return batched(documents.select("doc_id", "text")).mapInArrow(_encode(Vocabulary.load(model)), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def _decode(vocab: Vocabulary):
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().fill_null(vocab.unknown_id).to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.array([0 if x is None else x for x in _sizes(lists)], np.int64)
            out, at = decode_block(vocab, flat, np.concatenate([[0], np.cumsum(size)]))
            raw, null = out.tobytes(), lists.is_null().to_pylist()
            texts = [None if gone else raw[a:b].decode("utf-8", "replace") for a, b, gone in zip(at[:-1], at[1:], null, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _sizes(lists: pa.Array) -> list:
    import pyarrow.compute as pc

    return pc.list_value_length(lists).to_pylist()


def decoded(ids: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of its ids."""
    return batched(ids.select("doc_id", F.col("ids").cast("array<int>"))).mapInArrow(_decode(Vocabulary.load(model)), "doc_id long, text string")
