"""Token ids in Arrow files of fixed-size lists, written by range of ids and read back.

Each range partition of documents becomes one file in Arrow's random-access file format. Its ids run on
over sequences of equal length; a batch holds ``ids`` and two masks as fixed-size lists, so sequence i
is a slice of a memory map. All batches but the last have equally many sequences, so that a division
finds the batch. The masks say which places hold an id and which id ends a document, and ``doc_ids``
names the documents that end in a sequence. Only a file's last sequence is padded. Files are written
under another name and then moved, so a task that runs again after a lost executor replaces its file
as a whole.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, new_path, stage

#: Id that ends each document; fixed by the contract.
END = 1
#: Runs whose ids a worker keeps, in each of two generations; bytes of text encoded at once; runs given to the tokenizer at once.
CACHE, CHUNK, CALL = 400_000, 1 << 22, 2_000
#: What a tokenizer file must say for its texts to be encoded run by run. White space between tokens is
#: dropped, no token crosses it, and the case of letters makes no difference.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class _Kept:
    """A cache of two generations: what is used stays, what isn't goes when the younger one is full twice."""

    def __init__(self):
        self.young, self.old = {}, {}

    def missing(self, keys) -> list[bytes]:
        """Distinct keys that aren't known; those of the older generation move to the younger."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for k in set(keys).difference(young):
            if k in old:
                young[k] = old[k]
            else:
                out.append(k)
        return out


_SPACE, _LETTER, _MARK = np.zeros((3, 256), bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def runs_of(data: np.ndarray, ends: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The runs between ASCII white space of several texts' bytes, and by text where its runs end.

    ASCII letters are in lower case, and the punctuation at the end of a run, if a letter is before it, is a run of
    its own, as no token crosses that place. A run that may hold a special token stays as it is written.
    """
    space, low = _SPACE[data], _LOWER[data]
    first = np.append(True, space[:-1])
    last = np.append(space[1:], True)
    inside = ends[(ends > 0) & (ends < len(data))]
    first[inside] = last[inside - 1] = True  # a text's first and last bytes
    first &= ~space
    begins, stops = np.flatnonzero(first), np.flatnonzero(last & ~space)
    plain = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[stops]  # a run's last byte that isn't punctuation
    cut = (plain >= begins) & (plain < stops) & _LETTER[data[plain]]
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # <|
    for i in np.unique(np.searchsorted(begins, special, "right") - 1).tolist():
        low[begins[i] : stops[i] + 1], cut[i] = data[begins[i] : stops[i] + 1], False
    first[plain[cut] + 1] = True
    starts, kept = np.flatnonzero(first), ~space
    offsets = np.append(np.cumsum(kept)[starts] - 1, kept.sum()).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[kept])])
    return runs.dictionary_encode(), np.searchsorted(starts, ends, "left")


def splits_at_space(form: dict) -> bool:
    """Whether a tokenizer (its file as JSON) encodes a text like its runs between ASCII white space, ignoring case."""
    added = all("<|" in t["content"] and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) and len(t["content"].split()) == 1 for t in form["added_tokens"])
    steps = {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
    return added and form["normalizer"] == NORMALIZER and form["pre_tokenizer"] == steps and form["model"].get("end_of_word_suffix") == "</w>" and not form["truncation"]


class WordEncoder:
    """Encodes whole texts: run by run where the tokenizer allows it, so that each distinct run is encoded once.

    Any other tokenizer gets the texts as they are. Ids take 16 bits, or 32 for a vocabulary over 65536.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.runs = Tokenizer.from_file(path), _Kept()
        with open(path, encoding="utf-8") as file:
            self.by_runs = splits_at_space(json.load(file))
        top = max(self.tokenizer.get_vocab().values(), default=0)
        self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.ends = np.zeros(top + 1, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words of letters alone go as one text, cut where a token ends a word."""
        out = {}
        plain = [w for w in words if w.isalpha()]
        if plain:
            ids = self._ids([" ".join(plain)])[0]
            ends = (self.kind.itemsize * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) == len(plain):  # a letter that changes into several tokens in lower case would add an end
                data, at = ids.tobytes(), 0
                for w, end in zip(plain, ends, strict=True):
                    out[w], at = data[at:end], end
        rest = [w for w in words if w not in out]
        out.update((w, x.tobytes()) for w, x in zip(rest, self._ids(rest), strict=True))
        return [out[w] for w in words]

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of a string column's texts, each with END after it, and how many each text has, in pieces of whole texts."""
        column = column.fill_null("")
        upto, at = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < len(column):
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + CHUNK, "right")))
            yield self._piece(column.slice(at, end - at)) if self.by_runs else self._texts(column.slice(at, end - at))
            at = end

    def _texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        end = np.array([END], self.kind)
        found = [np.concatenate([x, end]) for x in self._ids(column.to_pylist())]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _piece(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        runs, ends = runs_of(data, ends[1:] - ends[0]) if len(data) else (pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(column), np.int64))
        words = runs.dictionary.to_pylist()
        new = self.runs.missing(words)
        for i in range(0, len(new), CALL):
            self.runs.young.update(zip(new[i : i + CALL], self._encode([w.decode() for w in new[i : i + CALL]]), strict=True))
        parts = [*map(self.runs.young.__getitem__, words), np.array([END], self.kind).tobytes()]
        data = np.frombuffer(b"".join(parts), self.kind)
        lens = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        starts = np.cumsum(lens) - lens
        order = np.insert(runs.indices.to_numpy().astype(np.int64), ends, len(words))  # END after each text's runs
        each = lens[order]
        upto = np.cumsum(each)
        ids = data[np.repeat(starts[order] - (upto - each), each) + np.arange(upto[-1])]
        return ids, np.diff(upto[ends + np.arange(len(ends))], prepend=0)


@functools.cache
def encoder_of(path: str) -> WordEncoder:
    """One encoder for each worker process, which keeps what it knows from task to task."""
    return WordEncoder(path)


def file_schema(length: int, kind: np.dtype) -> pa.Schema:
    bits = pa.list_(pa.bool_(), length)
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", bits), ("ends", bits), ("doc_ids", pa.list_(pa.int64()))])


def sequences(ids: np.ndarray, ends: np.ndarray, doc_ids: list, length: int) -> pa.RecordBatch:
    """Whole sequences, or the last one padded, as a batch. ``ends`` marks each document's last id."""
    rows, room = -(-len(ids) // length), -(-len(ids) // length) * length
    padded, mask, marks = np.zeros(room, ids.dtype), np.zeros(room, bool), np.zeros(room, bool)
    padded[: len(ids)], mask[: len(ids)], marks[: len(ids)] = ids, True, ends
    per = np.concatenate([[0], np.cumsum(marks.reshape(rows, length).sum(1))]).astype(np.int32)
    fixed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), length)
    return pa.record_batch([fixed(padded), fixed(mask), fixed(marks), pa.ListArray.from_arrays(pa.array(per), pa.array(doc_ids, pa.int64()))], schema=file_schema(length, ids.dtype))


def write_file(fs: pafs.FileSystem, path: str, docs: Iterator[tuple[list, np.ndarray, np.ndarray]], length: int, kind: np.dtype, rows: int = 256) -> tuple[int, int]:
    """Write documents in the order given; documents and ids written. ``rows`` sequences make a batch.

    ``docs`` gives some documents' names, all their ids, and the number of ids of each, again and again.
    """
    made, count, total = f"{path}.{uuid.uuid4().hex}.part", 0, 0
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(made) as out, pa.ipc.new_file(out, file_schema(length, kind)) as writer:
        ids, marks, names = np.zeros(0, kind), np.zeros(0, bool), []

        def write(cut: int) -> None:
            nonlocal ids, marks, names
            done = int(marks[:cut].sum())
            writer.write_batch(sequences(ids[:cut], marks[:cut], names[:done], length))
            ids, marks, names = ids[cut:], marks[cut:], names[done:]

        for doc_ids, own, lengths in docs:
            ends = np.zeros(len(own), bool)
            ends[np.cumsum(lengths) - 1] = True
            ids, marks = np.concatenate([ids, own]), np.concatenate([marks, ends])
            names += doc_ids
            count, total = count + len(lengths), total + len(own)
            while len(ids) >= rows * length:
                write(rows * length)
        if len(ids):
            write(len(ids))
    fs.move(made, path)
    return count, total


def _batches(fs: pafs.FileSystem, path: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """By batch of a file the documents that end in it, its ids without padding, and where documents end. A local file is mapped, not copied."""
    opened = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
    with opened as source:
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            batch = reader.get_batch(i)
            held = pc.sum(batch.column("mask").flatten()).as_py()
            ends = np.flatnonzero(batch.column("ends").flatten().to_numpy(zero_copy_only=False)) + 1
            yield batch.column("doc_ids").flatten().to_pylist(), batch.column("ids").flatten().to_numpy()[:held], ends


def read_file(fs: pafs.FileSystem, path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file with their ids, in order."""
    rest = []
    for names, ids, ends in _batches(fs, path):
        at = 0
        for name, end in zip(names, ends.tolist(), strict=True):
            yield name, np.concatenate([*rest, ids[at:end]])
            rest, at = [], end
        rest.append(np.array(ids[at:]))  # the batch's memory goes with its map


def checked(fs: pafs.FileSystem, path: str) -> Iterator[tuple[int | None, int, int]]:
    """Of each document of a file, in order, its name, number of ids, and the crc32 of its ids as 32-bit integers."""
    crc, held = 0, 0
    for names, ids, ends in _batches(fs, path):
        data, at = memoryview(ids.astype("<u4").view(np.uint8)), 0
        for name, end in zip(names, ends.tolist(), strict=True):
            yield name, held + end - at, zlib.crc32(data[4 * at : 4 * end], crc)
            crc, held, at = 0, 0, end
        crc, held = zlib.crc32(data[4 * at :], crc), held + len(ids) - at


def sequence_at(path: str, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence ``i`` of a local file, both as views of the memory map; the mask's bits stay packed."""
    reader = pa.ipc.open_file(pa.memory_map(path))
    rows = reader.get_batch(0).num_rows if reader.num_record_batches else 1
    if not 0 <= i // rows < reader.num_record_batches:
        raise IndexError(i)
    batch = reader.get_batch(i // rows)
    if i % rows >= batch.num_rows:
        raise IndexError(i)
    return batch.column("ids")[i % rows].values.to_numpy(), batch.column("mask")[i % rows].values


def export(docs: DataFrame, tokenizer: str, folder: str, length: int = 2048) -> DataFrame:
    """Encode all of ``docs`` (doc_id, text) and write them to ``folder`` in ascending doc_id.

    One file for each range of ids, named by its place in the order. Returns part, path, docs, ids.
    Null ids come last and are stored as null; null and empty texts are just the end id. Rows with the
    same id are ordered by text. Very long texts run over as many sequences as they need.
    """
    spark = docs.sparkSession
    attach(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    # besides the pass that samples the ids, each text is read and crosses the network once
    ranged = keyed.repartitionByRange(n, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder, part = encoder_of(tokenizer), first.column("part")[0].as_py()

        def encoded() -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
            batch = first
            while batch is not None:
                names, at = batch.column("doc_id").to_pylist(), 0
                for ids, lengths in encoder.encode(batch.column("text")):
                    yield names[at : at + len(lengths)], ids, lengths
                    at += len(lengths)
                batch = next(batches, None)

        fs, root = pafs.FileSystem.from_uri(folder)
        path = f"{root}/part-{part:06d}.arrow"
        count, total = write_file(fs, path, encoded(), length, encoder.kind)
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "path": [path], "docs": pa.array([count], pa.int64()), "ids": pa.array([total], pa.int64())})

    return ranged.mapInArrow(write, "part int, path string, docs long, ids long")


def read_back(files: DataFrame, folder: str) -> DataFrame:
    """Of every document in the files: doc_id, start, n_tokens, ids_crc32. ``files`` as from export(), written.

    The files' totals (one row a file) give where each file starts in the whole stream.
    """
    spark = files.sparkSession
    attach(spark)
    at, starts = 0, []
    for r in files.orderBy("part").collect():  # one row for each file
        starts.append((r.part, r.path, at))
        at += r.ids
    table = spark.createDataFrame(starts, "part int, path string, at long").repartition(max(1, len(starts)), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)

        def batch(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("at").to_pylist(), strict=True):
                rows = []
                for doc_id, size, crc in checked(fs, path):
                    rows.append((doc_id, start, size, crc))
                    start += size
                    if len(rows) == 4096:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, length: int = 2048) -> DataFrame:
    """Write ``docs`` to the shared folder and describe every document as read from the files."""
    folder = new_path(docs.sparkSession, "tokens")
    files = stage(export(docs, tokenizer, folder, length), "token-files")
    return read_back(files, folder)
