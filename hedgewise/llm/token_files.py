"""Token ids as Arrow files of equal-length sequences.

Each task writes one Arrow IPC file: record batches of a fixed number of rows, each row a fixed-size list of
ids and a fixed-size list of mask bits, so that sequence ``k`` of a file is row ``k % rows`` of batch
``k // rows`` and can be read from a memory map without a copy. Documents follow one another in id order,
each closed by an end id; only a file's last sequence is padded (mask off). A second Arrow file lists the
documents of the first: id, offset of the first token, and length.

A task names its files freshly at every attempt and the manifest holds the names of successful attempts
only, so lost executors leave unused files behind but never wrong rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from hedgewise.llm.common import slices, texts_of
from hedgewise.session import materialise, scratch_path

SEQUENCE_LENGTH = 2048
SEQUENCES_PER_BATCH = 32
CACHED_WORDS = 400_000
WORDS_PER_CALL, WORDS_PER_TEXT = 4096, 64


class WordEncoder:
    """Ids of texts under a tokenizer that never joins text across white space.

    Such a tokenizer gives a text the ids of its white-space separated words in turn, so each distinct word
    is encoded once by the library and texts are put together from the results. A word that ends in ASCII
    marks after an ASCII letter is put together from its stem and its marks, for those marks at which the
    tokenizer proves to cut. Where no special string can occur, ASCII letters are folded first as the
    tokenizer would, and words are handed over many at a time with a special token between them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.dtype = np.uint16 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        ids = lambda text: self.library.encode(text, add_special_tokens=False).ids
        self.lowers = ids("A") == ids("a")
        added = sorted((t.content, k) for k, t in self.library.get_added_tokens_decoder().items() if t.special)
        self.special = sorted({content[:2] for content, _ in added})
        self.between = added[0] if added and ids(f"a{added[0][0]}b") == [*ids("a"), added[0][1], *ids("b")] else None
        marks = [c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'"]
        self.marks = "".join(c for c in marks if ids(f"ab{c}") == ids("ab") + ids(c) and ids(f"ab{c}.") == ids("ab") + ids(f"{c}."))

    def _encoded(self, words: list[str], plain: bool) -> list[bytes]:
        if not (plain and self.between):
            return [np.asarray(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        text, number = self.between
        chunks = [words[k : k + WORDS_PER_TEXT] for k in range(0, len(words), WORDS_PER_TEXT)]
        out: list[bytes] = []
        for e in self.library.encode_batch_fast([text.join(c) for c in chunks], add_special_tokens=False):
            ids = np.asarray(e.ids, np.int64)
            cuts = [-1, *np.flatnonzero(ids == number).tolist(), len(ids)]
            raw, width = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
            out += [raw[(a + 1) * width : b * width] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _parts(self, word: str, plain: bool) -> tuple[str, str]:
        """The word's stem and its closing marks, which may be empty."""
        stem = word.rstrip(self.marks) if plain else word
        return (stem, word[len(stem) :]) if stem and stem[-1].isascii() and stem[-1].isalpha() else (word, "")

    def _pieces(self, words: list[str], plain: bool) -> list[bytes]:
        parts = [self._parts(w, plain) for w in words]
        missing = [p for p in dict.fromkeys(x for pair in parts for x in pair if x) if p not in self.cache]
        if missing and len(self.cache) + len(missing) > CACHED_WORDS:
            self.cache.clear()
            missing = list(dict.fromkeys(x for pair in parts for x in pair if x))
        for k in range(0, len(missing), WORDS_PER_CALL):
            part = missing[k : k + WORDS_PER_CALL]
            self.cache.update(zip(part, self._encoded(part, plain), strict=True))
        get = self.cache.__getitem__
        return [get(a) + get(b) if b else get(a) if a else b"" for a, b in parts]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, each text closed by ``end_id``, and the length of each."""
        plain = not any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if plain and self.lowers else texts)
        words, owners = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy()
        pieces = self._pieces(words.dictionary.to_pylist(), plain)
        flat = np.frombuffer(b"".join(pieces), self.dtype)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces)) // flat.itemsize
        begin = np.cumsum(length) - length
        at = words.indices.to_numpy()
        n = length[at]
        before = np.cumsum(n) - n
        total = int(n.sum())
        source = np.repeat(begin[at] - before, n) + np.arange(total)
        per_text = np.bincount(owners, weights=n, minlength=len(texts)).astype(np.int64)
        out = np.full(total + len(texts), end_id, self.dtype)
        out[np.arange(total) + np.repeat(owners, n)] = flat[source]
        return out, per_text + 1


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class SequenceWriter:
    """Cuts a stream of ids into full sequences and pads the last one."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int):
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.docs_path = f"{root}/{name}.arrow", f"{root}/{name}.docs.arrow"
        self.length, self.step, self.dtype = length, length * SEQUENCES_PER_BATCH, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
        self.sink, self.docs_sink = self.fs.open_output_stream(self.path), self.fs.open_output_stream(self.docs_path)
        self.file, self.docs = pa.ipc.new_file(self.sink, self.schema), pa.ipc.new_file(self.docs_sink, self.docs_schema)
        self.rest, self.n_ids, self.n_docs = np.zeros(0, dtype), 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        offsets = self.n_ids + np.cumsum(lengths) - lengths
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(offsets), pa.array(lengths)], schema=self.docs_schema))
        self.n_ids, self.n_docs = self.n_ids + len(ids), self.n_docs + len(lengths)
        ids = np.concatenate([self.rest, ids])
        full = len(ids) // self.step * self.step
        for at in range(0, full, self.step):
            self._write(ids[at : at + self.step], self.step)
        self.rest = ids[full:].copy()

    def _write(self, ids: np.ndarray, used: int) -> None:
        mask = np.arange(len(ids)) < used
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            padded = np.zeros(-(-len(self.rest) // self.length) * self.length, self.dtype)
            padded[: len(self.rest)] = self.rest
            self._write(padded, len(self.rest))
        for x in (self.file, self.docs, self.sink, self.docs_sink):
            x.close()


def write_token_files(
    df: DataFrame, tokenizer_path: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text", length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """Write the ids of all rows in ascending id order below ``folder``; returns the manifest.

    The manifest has one row per file: part (files in order), path, n_docs, n_ids, start (ids in all files
    before it). A null text is empty and has the end id only; rows without an id come first; rows with equal
    ids are ordered by text and all kept; an empty table gives no files. ``folder`` must be shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, part = word_encoder(tokenizer_path), None, TaskContext.get().partitionId()
        for batch in slices(batches, 1024):
            if writer is None:
                writer = SequenceWriter(folder, f"part-{part:06d}-{uuid.uuid4().hex}", encoder.dtype, length)
            ids, lengths = encoder.encode(texts_of(batch), end_id)
            writer.add(batch.column("doc_id"), ids, lengths)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": writer.path, "n_docs": writer.n_docs, "n_ids": writer.n_ids}])

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = materialise(ordered.mapInArrow(run, "part bigint, path string, n_docs bigint, n_ids bigint"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def open_sequences(path: str, folder: str) -> pa.ipc.RecordBatchFileReader:
    """A reader with random access to the batches; local files are memory-mapped."""
    fs, _ = pa.fs.FileSystem.from_uri(folder)
    local = isinstance(fs, pa.fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of the file's ``k``-th sequence; ids are a view into the file."""
    batch, row = reader.get_batch(k // SEQUENCES_PER_BATCH), k % SEQUENCES_PER_BATCH
    return batch.column("ids")[row].values.to_numpy(), batch.column("mask")[row].values.to_numpy(zero_copy_only=False)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            reader, docs = open_sequences(row["path"], folder), open_sequences(row["path"].replace(".arrow", ".docs.arrow"), folder)
            stream = (_used(reader.get_batch(i)) for i in range(reader.num_record_batches))
            held = np.zeros(0, "<u4")
            for i in range(docs.num_record_batches):
                batch = docs.get_batch(i)
                sums, lengths = [], batch.column("n_tokens").to_numpy()
                for n in lengths:
                    crc = 0
                    while n > len(held):
                        crc, n, held = zlib.crc32(held, crc), n - len(held), next(stream)
                    crc, held = zlib.crc32(held[:n], crc), held[n:]
                    sums.append(crc)
                starts = pc.add(batch.column("offset"), row["start"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), starts, batch.column("n_tokens"), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own keeps Spark from joining the tasks
    return manifest.repartition(files, "path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _used(batch: pa.RecordBatch) -> np.ndarray:
    ids, mask = batch.column("ids").values.to_numpy(), batch.column("mask").values.to_numpy(zero_copy_only=False)
    return ids[mask].astype("<u4")


def round_trip(df: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write all rows' ids below the shared folder and read the files back."""
    folder = scratch_path(df.sparkSession, "sequences")
    folder = folder if "://" in folder else f"file://{folder}"
    return read_token_files(write_token_files(df, tokenizer_path, end_id, folder), folder)
