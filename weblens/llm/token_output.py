"""Token ids of whole documents in binary files, with Elias-Fano coded document boundaries.

A file holds the ids of its documents one after the other, in ascending doc_id order, then an index,
then a trailer of fixed size:

    ids          little-endian, 2 bytes each for vocabularies of up to 65,536 ids, else 4
    ends         Elias-Fano: for each document, the number of ids up to its end
    doc_ids      Elias-Fano: ids of the documents, less the smallest one; null ids come first and have none
    trailer      magic, width of an id, documents, null ids, ids, smallest doc_id, bytes of both codes

Files are split by doc_id range, so file order and order inside a file give one order over all. The position of
a document is a select in `ends`; no table of 64-bit offsets exists.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import keep_cache, materialize, release_caches, shared_dir, slices, spark_schema, text_or_empty
from weblens.llm.elias_fano import EliasFano

MAGIC = b"WLTOKEN1"
_TRAILER = struct.Struct("<8sB7xQQQqQQ")
END_ID = 0
#: Bytes of pieces and their ids that a Python worker keeps, and what a piece takes besides its letters.
KEPT_BYTES, PIECE_BYTES = 80_000_000, 200
#: Bytes of texts that are cut at a time, unless one text alone is longer.
BATCH_BYTES = 6_000_000
#: Pieces that are encoded in one call's text, and pieces whose ids are gathered at a time.
TOGETHER, GATHERED = 500, 1 << 20

# The characters with the White_Space property.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_WHITE}]")
_WHITES = frozenset(c for c in map(chr, range(0x3001)) if _SPACE.match(c))
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: A letter before a sign; white space that is not single blanks and newlines, and the character that parts pieces.
_MARKED = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{3b1}-\x{3c9}\x{410}-\x{44f}])([!-/:-@\[-`{-~])"
_ODD = r"[\x00\t\x0b-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts.

    A byte-level BPE tokenizer without a normalizer never merges across the start of a run of white space, nor from a letter
    to a sign. So texts are cut there, and each distinct piece is encoded by the library once and kept: at most KEPT_BYTES
    of pieces, those in use most often. The ids of a text are gathered from its pieces' ids. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config.get("pre_tokenizer") or {}
        added = config.get("added_tokens", [])
        self.special = [t["content"] for t in added]
        self.by_piece = (
            config.get("model", {}).get("type") == "BPE"
            and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
            and not any(config.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
            and not any(_SPACE.search(s) for s in self.special)
        )
        # Texts with a special token are cut at white space only.
        self.odd = "|".join([_ODD, *map(re.escape, self.special)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 65_536 else "<u4")
        # Ids that start a piece with its blank, and the id of a newline: they part pieces that are encoded together.
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.newline = vocabulary.get("\u010a", -1)
        if self.by_piece and hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # pieces come once, so the library's own cache finds nothing
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.uses = np.zeros(0, dtype=np.int64)
        self.at = np.zeros(1, dtype=np.int64)
        self.table = np.zeros(0, dtype=self.dtype)
        self.kept_bytes = 0

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=self.dtype, count=int(sizes.sum())), sizes

    def _together(self, pieces: list[str], glue: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that start with a blank (no glue), or of pieces without white space (glued by newlines)."""
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        ids, counts = self._ids([glue.join(g) + glue for g in groups])
        marks = ids == self.newline if glue else self.opens[ids]
        cuts, total = np.flatnonzero(marks), np.cumsum(marks)
        ends = total[np.cumsum(counts) - 1] if len(groups) else total[:0]
        if np.diff(ends, prepend=0).tolist() != list(map(len, groups)):
            # A blank that is no token's start would not part its piece; there is none, and this keeps it so.
            return self._ids(pieces)
        if glue:  # a newline ends each piece
            return ids[~marks], np.diff(cuts, prepend=-1) - 1
        return ids, np.diff(cuts, append=len(ids))

    def _learn(self, new: list[str], clean: bool) -> None:
        """Encode pieces and keep them in this order. Those of `clean` texts have no other white space than a first blank."""
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        blank, bare, other = (k.append for k in kinds)
        for i, piece in enumerate(new):
            if len(piece) < 2:
                other(i)
            elif not clean and (_SPACE.search(piece, 1) or any(s in piece for s in self.special)):
                other(i)
            elif piece[0] == " ":
                blank(i)
            elif not clean and piece[0] in _WHITES:
                other(i)
            else:
                bare(i)
        parts = [[new[i] for i in k] for k in kinds]
        ids, sizes = zip(self._together(parts[0], ""), self._together(parts[1], "\n"), self._ids(parts[2]), strict=True)
        self.rows.update(zip(chain(*parts), range(at := len(self.rows), at + len(new)), strict=True))
        size = np.concatenate(sizes)
        self.uses = np.concatenate([self.uses, np.zeros(len(new), dtype=np.int64)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        self.table = np.concatenate([self.table, *ids])
        self.kept_bytes += sum(map(len, new)) * 2 + len(new) * PIECE_BYTES + int(size.sum()) * self.dtype.itemsize

    def _shrink(self) -> None:
        """Keep the half of the pieces that were used most; a single batch may hold more than the bound."""
        order = np.argsort(-self.uses, kind="stable")[: len(self.rows) // 2]
        stays = np.zeros(len(self.rows), dtype=bool)
        stays[order] = self.uses[order] > 1
        sizes = np.diff(self.at)
        names = [p for p, ok in zip(self.rows, stays.tolist(), strict=True) if ok]
        self.table = self.table[np.repeat(stays, sizes)]
        self.at = np.concatenate([[0], np.cumsum(sizes[stays])])
        self.uses = self.uses[stays] // 2
        self.rows = dict(zip(names, range(len(names)), strict=True))
        self.kept_bytes = sum(map(len, names)) * 2 + len(names) * PIECE_BYTES + self.table.nbytes

    def _rows_of(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.rows.get, names, repeat(-1)), dtype=np.int64, count=len(names))

    def _gather(self, pieces: pa.Array, bounds: np.ndarray, clean: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end ids, number of ids of each) from the pieces of all texts and their bounds."""
        coded = pieces.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = self._rows_of(names)
        if (new := np.flatnonzero(own < 0)).size:
            if self.kept_bytes > KEPT_BYTES:
                self._shrink()
                new = np.flatnonzero((own := self._rows_of(names)) < 0)
            asked = [names[i] for i in new.tolist()]
            self._learn(asked, clean)
            own[new] = self._rows_of(asked)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.uses[own] += np.bincount(codes, minlength=len(names))
        start, size = self.at[own], (self.at[1:] - self.at[:-1])[own]
        upto = np.concatenate([[0], np.cumsum(size[codes])])
        counts = upto[bounds[1:]] - upto[bounds[:-1]] + 1
        out = np.empty(int(upto[-1]) + len(counts), dtype=self.dtype)
        free = np.ones(len(out), dtype=bool)
        free[np.cumsum(counts) - 1] = False
        flat = np.empty(int(upto[-1]), dtype=self.dtype)
        for lo in range(0, len(codes), GATHERED):
            part = codes[lo : lo + GATHERED]
            first, last = upto[lo], upto[lo + len(part)]
            places = np.repeat(start[part] - upto[lo : lo + len(part)] + first, size[part])
            flat[first:last] = self.table[places + np.arange(last - first)]
        out[free] = flat
        out[~free] = END_ID
        return out, counts

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text and the end id after them, as little-endian bytes. `texts` has no nulls."""
        if not self.by_piece:
            ids, sizes = self._ids(texts.to_pylist())
            return self._binary(np.insert(ids, np.cumsum(sizes), END_ID), sizes + 1)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._binary(*self._gather(*self._plain(texts), True))
        out: list[bytes] = [b""] * len(texts)
        for rows, cut in ((np.flatnonzero(~odd), self._plain), (np.flatnonzero(odd), self._spaced)):
            if len(rows):
                found = self._binary(*self._gather(*cut(texts.take(pa.array(rows))), cut == self._plain))
                for i, ids in zip(rows.tolist(), found.to_pylist(), strict=True):
                    out[i] = ids
        return pa.array(out, pa.binary())

    @staticmethod
    def _plain(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of texts whose white space is single blanks and newlines, cut in Arrow."""
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        marked = pc.replace_substring_regex(marked, _MARKED, "\\1\0\\2")
        lists = pc.split_pattern(marked, "\0")
        offsets = lists.offsets.to_numpy()
        return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets.astype(np.int64) - offsets[0]

    @staticmethod
    def _spaced(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of any texts: a run of white space with what follows it, and the run at the end."""
        lists = [_CHUNK.findall(t) for t in texts.to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return pa.array([p for x in lists for p in x], pa.string()), bounds

    @staticmethod
    def _binary(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(counts * ids.dtype.itemsize)])
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]
        ).cast(pa.binary())


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder for the tasks of a Python worker, with the pieces that it knows, until another operator's tasks come."""
    keep_cache(__name__, encoder_of.cache_clear)
    return Encoder(path)


def _open(base: str):
    if "://" in base:
        return pafs.FileSystem.from_uri(base)
    return pafs.LocalFileSystem(), base


def encode_documents(documents: DataFrame, tokenizer: str, bounds: list[int], first: int = 1) -> DataFrame:
    """(bucket, doc_id, ids) of every row. Null ids come first, in `first` buckets; then bucket is the number of bounds below doc_id.

    An id that is several bounds at once has so many buckets, over which its rows are dealt by a hash of their texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    cuts, schema = np.array(bounds, dtype=np.int64), "bucket int, doc_id long, ids binary"
    out = to_arrow_schema(spark_schema(documents.sparkSession, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches(__name__)
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for part in slices(batch, 2, BATCH_BYTES, 1 << 16):
                doc_id = part.column(0)
                known = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
                turn = part.column(1).to_numpy()
                low, high = (np.searchsorted(cuts, known, side=side) for side in ("left", "right"))
                null = doc_id.is_null().to_numpy(zero_copy_only=False)
                # A hash below 2^20 times a number of buckets, over 2^20.
                bucket = np.where(null, (turn * first) >> 20, first + low + ((turn * np.maximum(high - low, 1)) >> 20))
                ids = encoder.encode(part.column(2))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), doc_id, ids], schema=out)
                del ids
                pa.default_memory_pool().release_unused()

    turn = F.pmod(F.xxhash64("text"), F.lit(1 << 20)).alias("turn")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.select("doc_id", turn, "text").mapInArrow(run, schema)


def write_tokens(documents: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of all documents to files in `folder`; one row per file: file, bucket, docs, ids.

    Each document's ids end with END_ID; a null or empty text has that id alone. Null doc_ids come first.
    Repeated ids stay apart, and an id of which there are many has several files: its rows are in the order of a hash of their texts
    there, and of their ids' bytes within a file. A very long text is one record, of which a task holds a few copies. An empty
    table writes no file. A task that runs again replaces its file as a whole.
    """
    tokenizer = tokenizer or default_tokenizer()
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    doc_id = F.col("doc_id").cast("long")
    seen = documents.select(
        F.percentile_approx(doc_id, shares or [0.5], 10_000).alias("cuts"), F.count("*").alias("rows"), F.count(doc_id).alias("named")
    ).first()
    bounds = sorted(seen["cuts"] or [])
    first = 1 + (seen["rows"] - seen["named"]) * parts // max(1, seen["rows"])
    wide = Encoder(tokenizer).dtype.itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        writer = None
        for batch in batches:
            for bucket, doc_id, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                writer = writer or _Writer(folder, bucket, wide)
                writer.add(doc_id, ids)
        if writer is not None:
            yield writer.close()

    encoded = encode_documents(documents, tokenizer, bounds, first)
    dealt = encoded.repartitionById(first + len(bounds) + 1, F.col("bucket"))
    ordered = dealt.sortWithinPartitions(F.col("bucket"), F.col("doc_id").asc_nulls_first(), "ids")
    return materialize(ordered.mapInArrow(write, "file string, bucket int, docs long, ids long"), "token-files")


class _Writer:
    def __init__(self, folder: str, bucket: int, wide: int):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base.rstrip('/')}/part-{bucket:06d}.tok"
        self.partial = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.partial)
        self.bucket, self.wide, self.total, self.nulls = bucket, wide, 0, 0
        self.ends, self.doc_ids = array("Q"), array("q")

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.total += len(ids) // self.wide
        self.ends.append(self.total)
        if doc_id is None:
            self.nulls += 1
        else:
            self.doc_ids.append(doc_id)

    def close(self) -> pa.RecordBatch:
        least = self.doc_ids[0] if self.doc_ids else 0
        given = np.array(self.doc_ids, dtype=np.int64).astype(np.uint64) - np.array(least, dtype=np.int64).astype(np.uint64)
        ends = EliasFano.of(np.array(self.ends, dtype=np.uint64), self.total + 1).to_bytes()
        names = EliasFano.of(given, int(given[-1]) + 1 if len(given) else 1).to_bytes()
        self.out.write(ends)
        self.out.write(names)
        trailer = _TRAILER.pack(MAGIC, self.wide, len(self.ends), self.nulls, self.total, least, len(ends), len(names))
        self.out.write(trailer)
        self.out.close()
        self.fs.move(self.partial, self.path)
        row = {"file": [self.path], "bucket": [self.bucket], "docs": [len(self.ends)], "ids": [self.total]}
        kinds = pa.schema([("file", pa.string()), ("bucket", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())])
        return pa.RecordBatch.from_pydict(row, schema=kinds)


class TokenFile:
    """Reads one file; only the index is held in memory."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(_TRAILER.size, size - _TRAILER.size)
        magic, self.wide, self.docs, self.nulls, self.total, self.least, ends, names = _TRAILER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        at = size - _TRAILER.size - names
        self.names = EliasFano.from_bytes(self.file.read_at(names, at))
        self.ends = EliasFano.from_bytes(self.file.read_at(ends, at - ends))
        self.dtype = np.dtype("<u2" if self.wide == 2 else "<u4")

    def span(self, i: int) -> tuple[int, int]:
        """(start, end) of the i-th document in ids, by select."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.wide, start * self.wide), dtype=self.dtype)

    def doc_ids(self, lo: int, hi: int) -> list[int | None]:
        """The ids of documents lo to hi."""
        given = self.names.select_range(max(lo, self.nulls) - self.nulls, max(hi, self.nulls) - self.nulls)
        return [None] * (min(hi, self.nulls) - min(lo, self.nulls)) + (given + self.least).tolist()


def read_index(files: DataFrame, folder: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32, file, of every document.

    start counts the ids of all documents before it over all files. One row per file comes to the driver,
    to turn the files' totals into their starts.
    """
    spark = files.sparkSession
    rows = sorted(files.collect(), key=lambda r: r["bucket"])
    starts, at = [], 0
    for r in rows:
        starts.append((r["file"], at))
        at += r["ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"
    if not starts:
        return spark.createDataFrame([], schema)
    named = spark.createDataFrame(starts, "file string, start long").repartition(len(starts))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, _ = _open(folder)
                file = TokenFile(fs, path)
                for lo in range(0, file.docs, 4096):
                    hi = min(file.docs, lo + 4096)
                    e = file.ends.select_range(lo, hi)
                    b = np.concatenate([[file.ends.select(lo - 1) if lo else 0], e[:-1]]).astype(np.int64)
                    crc = [zlib.crc32(file.ids(x, y).astype("<u4").tobytes()) for x, y in zip(b.tolist(), e.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.doc_ids(lo, hi), pa.int64()),
                            pa.array(b + base),
                            pa.array(e - b),
                            pa.array(crc, pa.int64()),
                            pa.array([path] * len(b), pa.string()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                    )

    return named.mapInArrow(read, schema)


def _qualified(documents: DataFrame, folder: str) -> str:
    """The folder as a URI with its scheme: a bare path means the cluster's default file system to Spark."""
    context = documents.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def token_index(documents: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the token files of documents and return what their index says, one row for each row of documents.

    Columns: doc_id, start, n_tokens, ids_crc32, file. Only doc_id and text are read.
    """
    folder = folder or _qualified(documents, f"{shared_dir(documents.sparkSession).rstrip('/')}/weblens/tokens-{uuid.uuid4().hex}")
    return read_index(write_tokens(documents, folder, tokenizer), folder)
