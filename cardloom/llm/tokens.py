"""Token ids by a public tokenizer, and their flat binary files.

A file set is one folder. Each partition of the id-ordered documents has three flat files: ``ids``
(unsigned little-endian token ids, 16 bits wide where the vocabulary allows, else 32), ``docs`` (64-bit
doc_ids) and ``ends`` (64-bit ends of the documents, counted in tokens from the partition's start).
A partition's base, the tokens before it, is the prefix sum of the partitions' counts; the table
``manifest`` holds it. Readers map the files into memory.
"""

from __future__ import annotations

import os
import re
import string
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words whose ids a worker remembers in each of two generations, and characters of one remembered word at most.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64
#: Characters tokenized in one string.
CALL_CHARS = 1 << 16

_PIECE = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+\Z")
#: White space besides the four plain ones: beside other white space, such texts are tokenized without cutting.
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Memory(dict):
    """Ids of words. A word that is not known is noted down and gives None."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.new: set[str] = set()

    def __missing__(self, word: str) -> bytes | None:
        found = self.old.get(word)
        if found is None:
            self.new.add(word)
        else:
            self[word] = found
        return found

    def age(self, most: int) -> None:
        """Beyond ``most`` words, only those that come again in the next generation stay."""
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own, with memory for words that come again.

    A byte-level pre-tokenizer never joins a character with white space that follows it, so a text may
    be cut before each run of white space. A text that holds the string of an added token is not cut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks take the cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        alphabet = set(ByteLevel.alphabet())
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = isinstance(self.tokenizer.pre_tokenizer, ByteLevel) and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.cuts = plain and not any(set(a) & set(" \n") for a in self.added)
        self.width = np.zeros(self.size, np.int64)  # bytes of text under each id
        for token, i in vocabulary.items():
            self.width[i] = len(token) if set(token) <= alphabet else len(token.encode())
        self.words, self.pieces = Memory(), Memory()

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str], mark: str) -> None:
        """Ids of new words, each of which starts with ``mark`` (a space or a line end) and holds no other: tokenized in long strings, cut again at the marks."""
        parts, chars = [[]], 0
        for p in new:
            if chars > CALL_CHARS:
                parts.append([])
                chars = 0
            parts[-1].append(p)
            chars += len(p) + 1
        lead = mark if mark == " " else ""
        joined = [lead + lead.join(p) for p in parts]
        for some, text, found in zip(parts, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            if not some:
                continue
            ids = np.asarray(found.ids, "<u4")
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero(raw == ord(mark))[1:], len(raw))
            cuts = (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1) * 4
            whole, start = ids.tobytes(), 0
            for p, end in zip(some, cuts.tolist(), strict=True):
                self.words[p] = whole[start:end]
                start = end

    def _meet(self, new: set[str]) -> dict[str, bytes]:
        """Learns words that a space stands before, or that start with a line end; gives the ids of those that are too long to be remembered.

        Empty words and words with white space at an end come from runs of white space: they get no ids.
        """
        known, plain, lines, ended, once = self.words, set(), [], [], {}
        for p in new:
            body = p[1:] if p[:1] == "\n" else p
            if body != body.strip() or not body:
                continue
            if len(p) > REMEMBERED_CHARS:
                once[p] = self._whole(p if p[0] == "\n" else " " + p)
            elif p[0] == "\n":
                lines.append(p)
            elif (stem := p.rstrip(string.punctuation)) != p and stem.isalpha():  # letters and the punctuation after them are never one token
                ended.append((p, stem))
                if stem not in known and known[stem] is None:
                    plain.add(stem)
            else:
                plain.add(p)
        self._learn(list(plain), " ")
        self._learn(lines, "\n")
        for p, stem in ended:
            known[p] = known[stem] + self._piece(p[len(stem) :])
        return once

    def _piece(self, piece: str) -> bytes:
        found = self.pieces[piece]
        if found is None:
            self.pieces.new.clear()
            found = self._whole(piece)
            if len(piece) <= REMEMBERED_CHARS:
                self.pieces.age(REMEMBERED // 4)
                self.pieces[piece] = found
        return found

    def _uneven(self, text: str) -> bytes:
        """Ids of a text with runs of white space."""
        return self._whole(text) if _OTHER_SPACE.search(text) else b"".join(map(self._piece, _PIECE.findall(text)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its ids."""
        cut = [self.cuts and not any(a in t for a in self.added) for t in texts]
        words: list[str] = []
        ends = [0]
        for t, c in zip(texts, cut, strict=True):
            if c and t:
                words += t.replace("\n", " \n").split(" ")
            ends.append(len(words))
        found: list[bytes | None] = list(map(self.words.__getitem__, words))
        if self.words.new:
            new, self.words.new = self.words.new, set()
            once = self._meet(new)
            self.words.new.clear()
            for i in [i for i, f in enumerate(found) if f is None]:
                found[i] = self.words.get(words[i]) or once.get(words[i])
        out: list[bytes] = []
        for t, c, (a, b) in zip(texts, cut, pairwise(ends), strict=True):
            if not c:
                out.append(self._whole(t))
            elif None in (run := found[a + 1 : b]) or a < b and not words[a]:
                out.append(self._uneven(t))
            else:
                out.append((self._piece(words[a]) if a < b else b"") + b"".join(run))
        self.words.age(REMEMBERED)
        return [np.frombuffer(x, "<u4") for x in out]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Doc_ids and, for each, the ids of its text and the end id; a null text is empty. About 4 MB of text at a time."""
    coder, end = encoder(path), np.array([end_id], "<u4")

    def done(ids: list, texts: list[str]) -> tuple[list, list[np.ndarray]]:
        return ids, [np.concatenate([x, end]) for x in coder.encode(texts)]

    for batch in batches:
        ids, texts, chars = [], [], 0
        for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py() or "")
            chars += len(texts[-1])
            if chars > 1 << 22:
                yield done(ids, texts)
                ids, texts, chars = [], [], 0
        if ids:
            yield done(ids, texts)


# ---------------------------------------------------------------- flat files


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


#: Bytes of text that one file and the task that writes it take, about.
FILE_BYTES = 1 << 28


def file_count(docs: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """As many files as the texts' bytes ask for, and enough to keep the session's cores busy."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Writes ``docs (doc_id, text, ...)`` as token files in ``folder`` and returns the manifest.

    ``manifest``: ``part, path, width, docs, nulls, tokens, base``, one row per partition, also kept as a table in the folder.

    * Documents stand in ascending doc_id order, null first, rows of one doc_id in the order of their texts.
      ``nulls`` counts the documents without a doc_id, which are a partition's first; any 64-bit doc_id comes back.
    * A null text is empty: the end id alone. Repeated rows are written again. No rows make no files.
    * Without ``partitions``, the number of files grows with the bytes of the texts (``FILE_BYTES``).
    * A task writes under a name of its own and then renames, so a task that runs twice leaves one result.
    * Other columns are ignored.
    """
    spark = docs.sparkSession
    width = 2 if max(encoder(tokenizer_path).size, end_id + 1) <= 1 << 16 else 4
    n = partitions or file_count(docs)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = _filesystem(folder)
        names = {k: f"{root}/part-{part:06d}.{k}" for k in ("ids", "docs", "ends")}
        own = {k: f"{v}.{uuid.uuid4().hex}" for k, v in names.items()}
        store.create_dir(root, recursive=True)
        docs_out, total, nulls = 0, 0, 0
        files = {k: store.open_output_stream(v) for k, v in own.items()}
        for doc_ids, ids in encoded(batches, tokenizer_path, end_id):
            files["ids"].write(np.concatenate(ids).astype(f"<u{width}").tobytes())
            files["docs"].write(np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes())
            ends = total + np.cumsum([len(x) for x in ids])
            files["ends"].write(ends.astype("<u8").tobytes())
            docs_out, total, nulls = docs_out + len(doc_ids), int(ends[-1]), nulls + doc_ids.count(None)
        for k, f in files.items():
            f.close()
            store.move(own[k], names[k])
        if docs_out:
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:06d}"], "width": [width], "docs": [docs_out], "nulls": [nulls], "tokens": [total]})

    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    counts = ordered.mapInArrow(write, "part long, path string, width long, docs long, nulls long, tokens long")
    counts.write.mode("overwrite").parquet(f"{folder}/counts")
    return _manifest(spark, folder)


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Prefix sums over the counts, one row per file: never more than the partitions of the writing job."""
    rows, base, out = spark.read.parquet(f"{folder}/counts").orderBy("part").collect(), 0, []
    for r in rows:
        out.append((*r, base))
        base += r.tokens
    manifest = spark.createDataFrame(out, "part long, path string, width long, docs long, nulls long, tokens long, base long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class Flat:
    """A flat file as an array: mapped into memory where the store is local, else read range by range."""

    def __init__(self, store: pafs.FileSystem, path: str, kind: str):
        self.kind, self.file, self.map = np.dtype(kind), None, np.zeros(0, kind)
        if not isinstance(store, pafs.LocalFileSystem):
            self.file = store.open_input_file(path)
        elif store.get_file_info(path).size:
            self.map = np.memmap(path, kind, "r")

    def __getitem__(self, span: slice) -> np.ndarray:
        if self.file is None:
            return self.map[span]
        return np.frombuffer(self.file.read_at((span.stop - span.start) * self.kind.itemsize, span.start * self.kind.itemsize), self.kind)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, ``start`` counted over all partitions."""
    spark = manifest.sparkSession
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _filesystem(row["path"])
                ids, doc_ids, ends = (Flat(store, f"{path}.{k}", t) for k, t in (("ids", f"<u{row['width']}"), ("docs", "<i8"), ("ends", "<u8")))
                before = 0
                for a in range(0, row["docs"], 4096):
                    b = min(a + 4096, row["docs"])
                    to = ends[a:b].astype(np.int64)
                    start = np.concatenate([[before], to[:-1]])
                    before = int(to[-1])
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(start.tolist(), to.tolist(), strict=True)]
                    named = pa.array(np.asarray(doc_ids[a:b]), pa.int64(), mask=np.arange(a, b) < row["nulls"])
                    yield pa.RecordBatch.from_arrays([named, pa.array(start + row["base"]), pa.array(to - start), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "width", "docs", "nulls", "base").repartition(max(n, spark.sparkContext.defaultParallelism), "path")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
