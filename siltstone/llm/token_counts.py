"""Token counts without token ids: an Aho-Corasick pass lists the vocabulary matches of a chunk, and a dynamic
program over their ends carries only the best score and its number of pieces.

Matches come by end, longest first, and only a strictly better score replaces one, so ties go to the longest
last piece as in the encoder; a character that no piece covers counts as many byte pieces as it has bytes
(one, with a vocabulary that has no byte pieces).  Every distinct chunk of a run of texts is counted once,
and a bounded memo carries counts from run to run.

Null and empty texts count 0.  A text of any length is counted whole, rows that repeat each by themselves, and
columns other than doc_id and text are not read, whatever their names.  An empty table has no counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm import chunks as C
from siltstone.llm import kernel as K
from siltstone.llm.sentencepiece_codec import MARK, MODEL, Vocabulary
from siltstone.llm.shared import batched

MEMO = 400_000


class Counter:
    def __init__(self, vocab: Vocabulary):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for i in vocab.normal:
            self.matches.add_word(vocab.pieces[i], (len(vocab.pieces[i]), float(vocab.scores[i])))
        self.matches.make_automaton()
        self.unknown, self.bytes = vocab.unknown_score, vocab.byte_ids is not None
        self.joined = vocab.joined
        self.memo: dict[bytes, int] = {}

    def count(self, text: str) -> int:
        """Pieces of the best cut of a text whose spaces are piece marks."""
        n = len(text)
        best, pieces = [0.0] + [None] * n, [0] * (n + 1)
        done = 0  # ends up to here are final
        for end, (size, score) in self.matches.iter(text):
            end += 1
            while done < end - 1:
                done += 1
                self._cover(text, best, pieces, done)
            gain = best[end - size] + score
            if best[end] is None or gain > best[end]:
                best[end], pieces[end] = gain, pieces[end - size] + 1
            if size == 1:
                done = end
        while done < n:
            done += 1
            self._cover(text, best, pieces, done)
        return pieces[n]

    def _cover(self, text, best, pieces, end):
        """The last character of an end that no one-character piece reaches."""
        gain = best[end - 1] + self.unknown
        if best[end] is None or gain > best[end]:
            best[end], pieces[end] = gain, pieces[end - 1] + (len(text[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else 1)

    def block(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        buf, offs = C.spaced(buf, offs)
        starts, ends, first = C.chunks(buf, offs, self.joined)
        sample, number = C.unique(buf, starts, ends)
        raw, memo, counts = buf.tobytes(), self.memo, np.empty(len(sample), np.int64)
        for k, (a, b) in enumerate(zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)):
            chunk = raw[a:b]
            found = memo.get(chunk)
            if found is None:
                found = self.count(chunk.decode().replace(" ", chr(MARK)))
                if b - a <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[chunk] = found
            counts[k] = found
        return K.segment_sums(counts[number], first)


def _count(vocab: Vocabulary):
    def run(batches):
        counter = Counter(vocab)
        for rows, buf, offs in K.blocks(batches, limit=C.BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), pa.array(counter.block(buf, offs))], names=["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_tokens."""
    return batched(documents.select("doc_id", "text")).mapInArrow(_count(Vocabulary.load(model)), "doc_id long, n_tokens long")
