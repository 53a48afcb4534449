"""Encoding and decoding with a sentencepiece BPE model by a table of distinct chunks.

The library marks white space by a marker sign. If no piece of the model has the
marker after another sign, no merge crosses into a marker, and a text can be cut
before each run of markers: each distinct chunk (a run of markers and the word
after it) is segmented once by the library itself, and a text's ids are those of
its chunks, joined by position. The table lives in the task and is emptied when it
has TABLE_CHUNKS entries, so its memory doesn't grow with the input.

Cases: a null text counts as empty; an empty text is the end id alone and decodes to
an empty text. Signs outside the vocabulary become byte pieces. Very long texts and
very long words are encoded whole. Rows that repeat are encoded each. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_of

MARK = "▁"
TABLE_CHUNKS = 200_000
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def crosses_marks(processor: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether the model has a piece with the marker after another sign; its texts can't be cut at markers."""
    return any(re.search(f"[^{MARK}]{MARK}", processor.id_to_piece(i)) for i in range(processor.get_piece_size()))


class ChunkTable:
    """Chunk -> its ids (int32 bytes) and what they decode to."""

    def __init__(self, model: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        if crosses_marks(self.processor) or self.processor.encode(" a  ", out_type=str) != self.processor.encode(f"{MARK}a{MARK}{MARK}", out_type=str):
            raise ValueError("pieces of this model cross white-space markers, or its normaliser changes more than them")
        self.end = np.int32(self.processor.eos_id()).tobytes()
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}
        # a lone marker, as before the end of a text; the library encodes an empty text as nothing
        self.ids[MARK], self.texts[MARK] = np.int32(self.processor.piece_to_id(MARK)).tobytes(), " "

    def learn(self, chunks: set[str]) -> None:
        """Segment those chunks that the table lacks; the library puts the first marker before each itself."""
        if len(self.ids) > TABLE_CHUNKS:
            self.clear()
        new = [x for x in chunks if x not in self.ids]
        found = self.processor.encode([x[1:].replace(MARK, " ") for x in new], num_threads=1) if new else []
        decoded = self.processor.decode(found, num_threads=1) if new else []
        for chunk, ids, text in zip(new, found, decoded):
            self.ids[chunk] = np.array(ids, np.int32).tobytes()
            self.texts[chunk] = " " + text


@cache
def _table(model: str) -> ChunkTable:
    return ChunkTable(model)


def encode_batch(texts: list[str], table: ChunkTable) -> tuple[list[bytes], list[str]]:
    """The ids (int32 bytes, end id included) of each text and what they decode to."""
    cut = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    table.learn(set().union(*cut))
    ids = [b"".join(map(table.ids.__getitem__, x)) + table.end for x in cut]
    return ids, ["".join(map(table.texts.__getitem__, x))[1:] for x in cut]


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for batch in slices(batches):
            ids, decoded = encode_batch(batch.column(1).to_pylist(), table)
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
