"""Exact token counts of texts of any length by overlap resynchronisation.

A long text is encoded in overlapping chunks. Two neighbouring encodings are spliced at a position inside
their overlap at which both have a token boundary that is *proven* stable: the two characters around it are
neighbours in no piece of the vocabulary, so no merge can ever span it, whatever stands further left or
right. If an overlap holds no such position, the left chunk is widened until one appears or the text ends.
The sum of the spliced parts therefore equals the count of the whole text, while the encoder never holds
more than a chunk (or the widened stretch).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from hedgewise.llm.common import slices, texts_of

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 128
SPACE = "▁"


class Resynchroniser:
    """Counts the tokens of a sentencepiece model (BPE, spaces kept, dummy prefix allowed)."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_byte(i))
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def stable(self, text: str, at: int) -> bool:
        """No piece can span position ``at`` of the text."""
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.joined

    def _begins(self, text: str, start: int, end: int) -> np.ndarray:
        """Where each token of text[start:end] begins, as positions of the whole text."""
        offsets = self.model.encode(text[start:end], return_type="offset_mapping")["offsets"]
        return np.fromiter((begin for begin, _ in offsets), np.int64, len(offsets)) + start

    def count(self, text: str) -> tuple[int, int, int]:
        """Tokens, chunks used and widenings."""
        if len(text) <= self.chunk + self.overlap:
            return len(self.model.encode(text, return_type="numpy")), 1, 0
        tokens, chunks, widened = 0, 0, 0
        start, since = 0, 0
        while True:
            end, overlap = min(start + self.chunk + self.overlap, len(text)), self.overlap
            begins = self._begins(text, start, end)
            chunks += 1
            after = start + self.chunk
            if end == len(text):
                return tokens + int((begins >= since).sum()), chunks, widened
            following = self._begins(text, after, min(after + self.chunk + self.overlap, len(text)))
            splice = self._splice(text, begins, following, after, end)
            while splice is None and end < len(text):
                overlap *= 2
                widened += 1
                end = min(start + self.chunk + overlap, len(text))
                begins = self._begins(text, start, end)
                following = self._begins(text, after, min(max(after + self.chunk, end) + self.overlap, len(text)))
                splice = self._splice(text, begins, following, after, end)
            if splice is None:  # the left stretch reaches the end of the text
                return tokens + int((begins >= since).sum()), chunks, widened
            tokens += int(((begins >= since) & (begins < splice)).sum())
            start, since = after, splice

    def _splice(self, text: str, left: np.ndarray, right: np.ndarray, after: int, end: int) -> int | None:
        """The first stable boundary that both encodings have inside the overlap."""
        common = np.intersect1d(left[(left > after) & (left < end)], right[(right > after) & (right < end)])
        return next((int(p) for p in common if self.stable(text, int(p))), None)


@lru_cache(maxsize=4)
def resynchroniser(path: str, chunk: int, overlap: int) -> Resynchroniser:
    return Resynchroniser(path, chunk, overlap)


def count_tokens(
    df: DataFrame, model_path: str, limit: int, doc_id: str = "doc_id", text: str = "text",
    chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_chunks, n_widened.

    A null text is empty and has no tokens. Rows are independent: no shuffle, repeated rows stay.
    ``model_path`` must be readable on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resynchroniser(model_path, chunk, overlap)
        for batch in slices(batches, 1024):
            texts = texts_of(batch, "text")
            strings = texts.to_pylist()
            short = [i for i, t in enumerate(strings) if len(t) <= chunk + overlap]
            out = np.ones((len(strings), 3), np.int64)
            out[:, 2] = 0
            out[short, 0] = [len(x) for x in counter.model.encode([strings[i] for i in short], num_threads=1, return_type="numpy")]
            for i in set(range(len(strings))).difference(short):
                out[i] = counter.count(strings[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(out[:, 0]), pa.array(out[:, 0] > limit), pa.array(out[:, 1]), pa.array(out[:, 2])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
            )

    return df.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint, n_widened bigint"
    )
