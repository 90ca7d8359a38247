"""Token-id output: flat unsigned-integer files with 64-bit document offsets, read back by mmap.

Documents are range-partitioned and sorted by doc_id. Each partition encodes its texts and writes
three files: ``<part>.bin`` (token ids, little-endian, 16 bits where the vocabulary allows it, else
32), ``<part>.idx`` (n+1 unsigned 64-bit offsets, in ids) and ``<part>.doc`` (n signed 64-bit ids, the
smallest number for null). The parts' token counts go through a prefix sum, which gives each part its
base in the whole stream; a document's start is base + offset. Every document ends with ``end_id``.

Files go to a new folder under ``spark.checkpoint.dir`` (or ``folder``), which all executors share.
A part is written under a name of its own attempt and moved into place at its end, so a lost or
repeated task never leaves half a file. The files are the operator's product and stay.

Encoding: BPE never crosses a pre-token border, so texts are cut at such borders and equal pieces are
encoded once per worker (a table of bounded size); ids equal those of encoding the whole text.

Missing and odd input: a null text is empty and has the end id only; rows with the same doc_id are
ordered by the hash of their text, then the text; null ids come first; an empty table writes no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwise.llm.text import mix
from bandwise.session import checkpoint_dir, cut_lineage

_NULL_ID = -(2**63)
_KNOWN_PIECES = 2_000_000  # about 60 bytes each
_GROUP_CHARS = 1_500_000  # characters of the texts that are encoded together
_ENCODERS: dict[int, "Encoder"] = {}


class Encoder:
    """Encoding by pieces, each new piece once, with a bounded table of known ones.

    In a text whose only white space is single blanks and newlines, every blank or newline starts a
    pre-token (a newline is one by itself), so the ids of the text are those of its pieces: a blank
    or newline with the run of other characters behind it, cut again where ASCII punctuation follows
    an ASCII letter (letters and punctuation never share a pre-token). Pieces are found and told apart by a
    128-bit hash over the UTF-8 bytes of many texts at once; those not yet known are joined to one
    text, encoded, and told apart by the offsets of their tokens. Other texts are encoded whole.
    """

    other_space = re.compile(r"[^\S \n]")

    def __init__(self, definition: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode())
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.newline = len(self._whole("\n"))
        self.keys, self.others = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # halves of the hashes, by the first
        self.spans = np.zeros((0, 2), np.int64)  # of the ids below
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def plain(self, t: str) -> bool:
        return not (t[0] in " \n" or t[-1] in " \n" or "  " in t or "\n\n" in t or " \n" in t or "\n " in t or self.other_space.search(t))

    def _learn(self, pieces: list[bytes], keys: np.ndarray) -> None:
        """Add new pieces with their hashes (ascending)."""
        counts, found = np.zeros(len(pieces), np.int64), [np.zeros(0, np.uint32)] * len(pieces)
        joined = [i for i, p in enumerate(pieces) if p[0] in b" \n"]
        texts = [pieces[i].decode() for i in joined]
        if texts:
            begin = np.cumsum([0] + [len(t) for t in texts[:-1]])
            e = self.tokenizer.encode("".join(texts), add_special_tokens=False)
            at = np.searchsorted(begin, np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0], "right") - 1
            counts[joined] = np.bincount(at, minlength=len(texts))
            for i, ids in zip(joined, np.split(np.array(e.ids, np.uint32), np.cumsum(counts[joined])[:-1])):
                found[i] = ids
        for i, p in enumerate(pieces):
            if p[0] not in b" \n":  # punctuation behind a letter: few different ones
                found[i] = self._whole("x" + p.decode())[1:]
                counts[i] = len(found[i])
        new = np.concatenate(found)
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used: self.used + len(new)] = new
        place = np.searchsorted(self.keys, keys[:, 0])
        self.spans = np.insert(self.spans, place, np.stack([self.used + np.cumsum(counts) - counts, counts], 1), axis=0)
        self.keys, self.others = np.insert(self.keys, place, keys[:, 0]), np.insert(self.others, place, keys[:, 1])
        self.used += len(new)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        # the first piece of a text gets a newline of its own, whose ids are cut off again
        raw = ("\n" + "\n".join(texts)).encode()
        data = np.frombuffer(raw, np.uint8)
        first_byte = (data == 32) | (data == 10)
        first_byte[1:] |= _PUNCTUATION[data[1:]] & _LETTER[data[:-1]]
        starts = np.flatnonzero(first_byte)
        lens = np.diff(np.append(starts, len(data)))
        keys = _hashes(data, starts, lens)
        half, first, inverse = np.unique(keys[:, 0], return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, half)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == half[known]
        before = (self.keys, self.others, self.spans, self.used)
        if not known.all():
            new = first[~known]
            self._learn([raw[i: i + n] for i, n in zip(starts[new].tolist(), lens[new].tolist())], keys[new])
            where = np.searchsorted(self.keys, half)
        where = where[inverse]
        if not (self.others[where] == keys[:, 1]).all():  # two pieces share half a hash
            return [self._whole(t) for t in texts]
        begin, n = self.spans[where].T
        upto = np.cumsum(n)
        flat = self.ids[np.arange(int(upto[-1])) - np.repeat(upto - n, n) + np.repeat(begin, n)]
        if len(self.keys) > _KNOWN_PIECES:  # once the table is full, later pieces are not kept
            self.keys, self.others, self.spans, self.used = before
        ends = np.cumsum([len(t.encode()) + 1 for t in texts])
        cuts = upto[np.searchsorted(starts, ends) - 1]
        return [flat[a + self.newline: b] for a, b in zip(np.append(0, cuts[:-1]), cuts)]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        out: list = [None] * len(texts)
        group, size = [], 0
        for i, t in enumerate(texts):
            if not t or not self.plain(t):
                out[i] = self._whole(t) if t else np.zeros(0, np.uint32)
                continue
            group.append(i)
            size += len(t)
            if size >= _GROUP_CHARS:
                for j, e in zip(group, self._plain([texts[j] for j in group])):
                    out[j] = e
                group, size = [], 0
        if group:
            for j, e in zip(group, self._plain([texts[j] for j in group])):
                out[j] = e
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_PUNCTUATION = np.array([32 < i < 127 and not chr(i).isalnum() for i in range(256)])
_rng = np.random.Generator(np.random.PCG64(31))
_BYTES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = _rng.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(8) + np.uint64(5)


def _hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Two independent hashes of each piece ``data[start: start + len]``."""
    at = np.arange(len(data)) - np.repeat(starts, lens)
    out = np.empty((len(starts), 2), np.uint64)
    for k in (0, 1):
        powers = np.cumprod(np.full(int(lens.max()), _BASES[k], np.uint64))
        out[:, k] = mix(np.add.reduceat(_BYTES[k][data] * powers[at], starts))
    return out


def encoder(definition: bytes) -> Encoder:
    key = zlib.crc32(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


class Folder:
    """Files of a folder named by a path or URI; local ones are mapped, others read."""

    def __init__(self, uri: str):
        parts = urlparse(uri)
        self.local = parts.scheme in ("", "file")
        if self.local:
            self.path, self.fs = parts.path, None
        else:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(uri)

    def create(self, name: str):
        if self.local:
            os.makedirs(self.path, exist_ok=True)
            return open(f"{self.path}/{name}", "wb")
        self.fs.create_dir(self.path, recursive=True)
        return self.fs.open_output_stream(f"{self.path}/{name}")

    def move(self, old: str, new: str) -> None:
        if self.local:
            os.replace(f"{self.path}/{old}", f"{self.path}/{new}")
        else:
            self.fs.move(f"{self.path}/{old}", f"{self.path}/{new}")

    def open(self, name: str):
        return open(f"{self.path}/{name}", "rb") if self.local else self.fs.open_input_stream(f"{self.path}/{name}")

    def array(self, name: str, dtype: str) -> np.ndarray:
        if self.local:
            return np.memmap(f"{self.path}/{name}", dtype, "r") if os.path.getsize(f"{self.path}/{name}") else np.zeros(0, dtype)
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            return np.frombuffer(f.read(), dtype)


def _write(batches: Iterator[pa.RecordBatch], definition, folder: str, end_id: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    part, trial = task.partitionId(), f".{task.taskAttemptId()}"
    enc, out = encoder(definition.value), Folder(folder)
    dtype = "<u4" if enc.wide else "<u2"
    offsets, total = 0, 0
    kinds = ("bin", "idx", "doc")
    names = [f"{part:06d}.{k}" for k in kinds]
    with out.create(names[0] + trial) as ids, out.create(names[1] + trial) as idx, out.create(names[2] + trial) as doc:
        idx.write(np.zeros(1, "<u8").tobytes())
        for batch in batches:
            doc.write(np.asarray(batch.column("doc_id").fill_null(_NULL_ID)).astype("<i8").tobytes())
            for at in range(0, batch.num_rows, 1024):
                encoded = enc.encode_all(batch.column("text").slice(at, 1024).fill_null("").to_pylist())
                for e in encoded:
                    ids.write(np.append(e, end_id).astype(dtype).tobytes())
                ends = total + np.cumsum([len(e) + 1 for e in encoded])
                total = int(ends[-1])
                idx.write(ends.astype("<u8").tobytes())
            offsets += batch.num_rows
    for n in names:
        out.move(n + trial, n)
    if offsets:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([offsets], pa.int64()), pa.array([total], pa.int64()), pa.array([dtype])], ["part", "docs", "tokens", "dtype"])


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode and write all ``docs(doc_id, text)``; returns the folder and its manifest.

    The manifest has one row per part: ``part``, ``docs``, ``tokens``, ``dtype`` and ``base``, the
    tokens of all parts before it. ``tokenizer_path`` is read on the driver and sent to the tasks.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    with open(tokenizer_path, "rb") as f:
        definition = spark.sparkContext.broadcast(f.read())  # a vocabulary file of a few MB
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    manifest = cut_lineage(rows.mapInArrow(
        partial(_write, definition=definition, folder=folder, end_id=end_id), "part long, docs long, tokens long, dtype string"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    return folder, manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch], folder: str, digest: bool) -> Iterator[pa.RecordBatch]:
    src = Folder(folder)
    for batch in batches:
        for row in batch.to_pylist():
            name = f"{row['part']:06d}"
            ids, idx, doc = src.array(name + ".bin", row["dtype"]), src.array(name + ".idx", "<u8"), src.array(name + ".doc", "<i8")
            for a in range(0, len(doc), 4096):
                b = min(len(doc), a + 4096)
                spans = [ids[int(idx[i]): int(idx[i + 1])] for i in range(a, b)]
                last = (pa.array([zlib.crc32(s.astype("<u4").tobytes()) for s in spans], pa.int64()) if digest
                        else pa.array([s.astype(np.int32) for s in spans], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.asarray(doc[a:b]), pa.int64(), mask=np.asarray(doc[a:b]) == _NULL_ID),
                    pa.array(row["base"] + idx[a:b].astype(np.int64)), pa.array(np.diff(idx[a: b + 1].astype(np.int64))), last],
                    ["doc_id", "start", "n_tokens", "last"])


def read_tokens(spark, folder: str, manifest: DataFrame, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files, or ``ids_crc32`` for ids if ``digest``."""
    name, kind = ("ids_crc32", "long") if digest else ("ids", "array<int>")
    parts = manifest.repartitionByRange(max(1, manifest.count()), "part")  # a task per part
    return parts.mapInArrow(partial(_read, folder=folder, digest=digest), f"doc_id long, start long, n_tokens long, last {kind}").withColumnRenamed("last", name)


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write all documents, read the files back: ``(doc_id, start, n_tokens, ids_crc32)``."""
    folder, manifest = write_tokens(docs, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, folder, manifest, digest=True)
