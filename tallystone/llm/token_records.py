"""Token ids as length-delimited binary records with a separate offset index.

Documents are sorted by id over ranges of ids; each range becomes a record file and an index
file in a shared folder, written by the task that holds the range under a temporary name and then
renamed, so a task that runs twice leaves one complete file.

Record: ``length`` (unsigned 64-bit), masked checksum of the length field (unsigned 32-bit),
``length`` bytes of payload, masked checksum of the payload (unsigned 32-bit). Payload: the
document id (signed 64-bit), one byte with the width of a token id (plus 128 for a null
document id), the token ids.
All numbers are little-endian. A checksum is CRC-32, masked by a rotation and an offset so that
records can hold checksums. Index: one unsigned 64-bit record offset per record, in order. A reader seeks by
the index in any order.

Ids take two bytes when the vocabulary allows, else four.

Defined cases: null and empty texts have the end id alone; null document ids come first;
rows that share an id are ordered by their text; an empty table writes no file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.words import chunks
from tallystone.session import checkpoint_folder

END_ID = 1
TASK_BYTES = 16 << 20
_CACHE_WORDS, _CACHE_RUNS = 600_000, 1_000_000
_TOGETHER = 256
# words end in these without changing how their letters are encoded: the tokenizer splits letters from other marks
_CLOSING = b".,;:!?*$%&#|"
_encoders: dict[str, "WordEncoder"] = {}


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def pack(payload: bytes) -> bytes:
    """One framed record."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unpack(data: bytes | memoryview, offset: int) -> bytes:
    """The payload of the record at ``offset``; raises when a checksum does not hold."""
    length = bytes(data[offset : offset + 8])
    if struct.unpack_from("<I", data, offset + 8)[0] != masked(length):
        raise ValueError(f"damaged length at {offset}")
    end = offset + 12 + struct.unpack("<Q", length)[0]
    payload = bytes(data[offset + 12 : end])
    if struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError(f"damaged record at {offset}")
    return payload


class WordEncoder:
    """Encodes texts word by word with a tokenizer that drops white space and never joins words across it (checked; texts are encoded whole with any other).

    Words seen before come from a bounded table. A new word of letters and closing marks is put together from
    a second bounded table of letter runs (lower-cased where they are ASCII, as the tokenizer lower-cases) and marks;
    what neither table has is encoded in one batch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype, self.code = f"<u{self.width}", "H" if self.width == 2 else "I"
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word, ends = _splits_at_space(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        if ends:
            self.closes[[i for token, i in vocabulary.items() if token.endswith(ends)]] = True
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _run_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of letter runs and marks. Many letter runs are encoded as one text, whose words end at ids that close a word."""
        together = [t.isalpha() and t.lower().isalpha() for t in texts]
        out: dict[str, bytes] = {}
        letters = [t for t, k in zip(texts, together, strict=True) if k]
        groups = [letters[k : k + _TOGETHER] for k in range(0, len(letters), _TOGETHER)]
        apart = [t for t, k in zip(texts, together, strict=True) if not k]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            cuts = (np.flatnonzero(self.closes[ids]) + 1) * self.width
            if len(cuts) != len(group) or cuts[-1] != ids.nbytes:
                apart += group
                continue
            data, low = ids.tobytes(), 0
            for text, high in zip(group, cuts.tolist(), strict=True):
                out[text], low = data[low:high], high
        out.update(zip(apart, self._ids(apart), strict=True))
        return [out[t] for t in texts]

    def _learn(self, new: list[bytes]) -> None:
        """Add new words to the table."""
        parts = []
        for w in new:
            if w.isalpha():
                parts.append((w.lower(), b""))
                continue
            core = w.rstrip(_CLOSING)
            if core.isalpha():
                parts.append((core.lower(), w[len(core):]))
            elif core and core.decode().lower().isalpha():  # a letter that lower-cases to a letter and a mark joins what follows
                parts.append((core, w[len(core):]))
            else:
                parts.append((w, b""))
        if len(self.runs) > _CACHE_RUNS:
            self.runs.clear()
        runs = self.runs
        lacking = list({x for p in parts for x in p}.difference(runs))
        runs.update(zip(lacking, self._run_ids([x.decode() for x in lacking]), strict=True))
        self.known.update(zip(new, (runs[a] + runs[b] for a, b in parts), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text, without special tokens added, as little-endian bytes."""
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        # the string of a special token is matched before words are split: such a text is encoded whole
        split = [None if not self.by_word or b"<" in t and any(s in t.lower() for s in self.special) else t.split() for t in texts]
        words: set[bytes] = set()
        words.update(*(w for w in split if w))
        self._learn(list(words.difference(self.known)))
        get = self.known.__getitem__
        return [self._ids([t.decode()])[0] if words is None else b"".join(map(get, words)) for t, words in zip(texts, split, strict=True)]


def _splits_at_space(made: dict) -> tuple[bool, str | None]:
    """Does a tokenizer drop white space and treat letters apart from other marks, whatever stands around them; and what ends its words."""
    steps = lambda part, name: [] if part is None else part[name] if part["type"] == "Sequence" else [part]
    normal = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "
                 for n in steps(made["normalizer"], "normalizers"))
    pre = steps(made["pre_tokenizer"], "pretokenizers")
    first = pre[0] if pre else {}
    # the words are what the pattern matches: contractions, letters, single digits, other marks
    words = (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
             and re.sub(r"[\[\]+]", "", first["pattern"].get("Regex", "")).endswith(r"|\p{L}|\p{N}|^\s\p{L}\p{N}"))
    rest = all(p["type"] == "ByteLevel" and not p["use_regex"] and not p["add_prefix_space"] for p in pre[1:])
    return normal and words and rest and made["model"]["type"] == "BPE" and not made["model"].get("ignore_merges"), made["model"].get("end_of_word_suffix")


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if re.match(r"\w+:", folder) else f"file://{folder}")


def write_records(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> list[tuple[int, int, int]]:
    """Write the documents under ``folder``; returns (part, number of documents, number of ids) of each file, in order."""
    named = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    size = named.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, base = _store(folder)
        words = encoder(tokenizer)
        end = np.array([END_ID], words.dtype).tobytes()
        offsets, at, tokens, stream = [], 0, 0, None
        mark = f"{base}/.{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for start, stop, texts in chunks(batch.column("body")):
                own = batch.column("id").slice(start, stop - start).to_pylist()
                cuts, data = texts.bounds, texts.data.tobytes()
                bodies = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                for doc, ids in zip(own, words.encode(bodies), strict=True):
                    head = struct.pack("<qB", doc or 0, words.width + 128 * (doc is None))
                    record = pack(head + ids + end)
                    if stream is None:
                        store.create_dir(base, recursive=True)
                        stream = store.open_output_stream(mark)
                    stream.write(record)
                    offsets.append(at)
                    at += len(record)
                    tokens += (len(ids) + len(end)) // words.width
        if stream is None:
            return
        stream.close()
        with store.open_output_stream(mark + "i") as index:
            index.write(np.array(offsets, "<u8").tobytes())
        store.move(mark, f"{base}/part-{part:06d}.rec")
        store.move(mark + "i", f"{base}/part-{part:06d}.idx")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(offsets)], "n_tokens": [tokens]})

    order = (F.col("id").asc_nulls_first(), F.xxhash64("body").asc())
    ranged = named.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return sorted(map(tuple, ranged.mapInArrow(write, "part long, n_docs long, n_tokens long").collect()))


def read_records(spark: SparkSession, folder: str, files: list[tuple[int, int, int]]) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` (unsigned 32-bit, little-endian) of each record."""
    starts = np.concatenate([[0], np.cumsum([n for _, _, n in files])]).astype(int).tolist()
    plan = spark.createDataFrame([(p, s) for (p, _, _), s in zip(files, starts, strict=False)], "part long, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/part-{part:06d}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8").tolist()
                with store.open_input_file(f"{base}/part-{part:06d}.rec") as f:
                    data = memoryview(f.read())
                for low in range(0, len(offsets), 256):
                    out = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                    for offset in offsets[low : low + 256]:
                        payload = unpack(data, offset)
                        doc, kind = struct.unpack_from("<qB", payload)
                        ids = np.frombuffer(payload, f"<u{kind & 127}", offset=9).astype("<u4")
                        for name, value in zip(out, (None if kind & 128 else doc, start, len(ids), ids.tobytes()), strict=True):
                            out[name].append(value)
                        start += len(ids)
                    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                        ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]))

    return plan.repartition(max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_records(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` into a new folder of the shared one and read the records back."""
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/records-{uuid.uuid4().hex}"
    return read_records(spark, folder, write_records(docs, folder, tokenizer, doc_id, text))
