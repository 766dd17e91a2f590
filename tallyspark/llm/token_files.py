"""Token ids in bit-plane files: fixed-size id blocks, transposed to planes, each plane compressed, with a chunk index.

File layout (little-endian): magic, the planes of all blocks one after another, the index, its length as an
unsigned 64-bit integer, magic. The index is a zstandard frame of JSON metadata, document ids, document lengths
and the chunk index: for every block its number of ids and the bytes of each of its planes (0: all bits clear).
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import shared

MAGIC = b"TBPLANE1"
BLOCK_IDS = 1 << 16
END_ID = 2
PLANES = {"bit": 32, "byte": 4}


# ---------------------------------------------------------------- planes


def _turn(bytes_of: np.ndarray) -> np.ndarray:
    """Transposes each 8 by 8 bit square of a vector of bytes (its length a multiple of 8): its own inverse."""
    x = bytes_of.view("<u8")
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ t ^ (t << np.uint64(shift))
    return x.view(np.uint8)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of one block; ids are padded to whole bytes of bits. Planes without a set bit come back empty."""
    n = -(-len(ids) // 8) * 8 if kind == "bit" else len(ids)
    own = np.zeros((n, 4), np.uint8)
    own[: len(ids)] = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes: list[bytes] = []
    for k in range(4):
        column = np.ascontiguousarray(own[:, k])
        rows = [column] if kind == "byte" else np.ascontiguousarray(_turn(column).reshape(-1, 8).T)
        planes += [row.tobytes() if row.any() else b"" for row in rows]
    return planes


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    each = 8 if kind == "bit" else 1
    padded = -(-n // 8) * 8 if kind == "bit" else n
    own = np.zeros((padded, 4), np.uint8)
    for k in range(4):
        some = planes[each * k : each * k + each]
        if not any(some):
            continue
        rows = np.zeros((each, padded // each), np.uint8)
        for row, plane in zip(rows, some):
            if plane:
                row[:] = np.frombuffer(plane, np.uint8)
        own[:, k] = rows[0] if kind == "byte" else _turn(np.ascontiguousarray(rows.T).reshape(-1))
    return own.view("<u4").reshape(-1)[:n]


class Writer:
    """Writes one file; add() takes the ids of some documents, end to end, and their lengths."""

    def __init__(self, out, kind: str = "bit", block_ids: int = BLOCK_IDS, level: int = 3):
        self.out, self.kind, self.block_ids = out, kind, block_ids
        self.pack = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.doc_ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.chunks: list[list[int]] = []
        self.at = self.out.write(MAGIC) or len(MAGIC)

    def add(self, doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(np.stack([doc_ids.astype("<i8"), valid.astype("<i8")]))
        self.lengths.append(lengths.astype("<i8"))
        self.waiting.append(ids.astype("<u4", copy=False))
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block_ids:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block_ids * self.block_ids
            for start in range(0, whole, self.block_ids):
                self._block(ids[start : start + self.block_ids])
            self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.pack.compress(x) if x else b"" for x in to_planes(ids, self.kind)]
        self.out.write(b"".join(packed))
        self.chunks.append([len(ids), *map(len, packed)])

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        docs = np.concatenate(self.doc_ids, axis=1) if self.doc_ids else np.zeros((2, 0), "<i8")
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, "<i8")
        about = json.dumps({"kind": self.kind, "docs": docs.shape[1], "chunks": len(self.chunks)}).encode()
        chunks = np.array(self.chunks, "<i8").reshape(len(self.chunks), -1)
        index = self.pack.compress(
            struct.pack("<q", len(about)) + about + docs.tobytes() + lengths.tobytes() + chunks.tobytes()
        )
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)


class Reader:
    """Reads a file by its chunk index; blocks() gives the ids block by block."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a bit-plane token file, or cut short")
        (n,) = struct.unpack("<Q", tail[:8])
        index = zstandard.ZstdDecompressor().decompress(self._at(size - 16 - n, n))
        (n,) = struct.unpack_from("<q", index)
        about = json.loads(index[8 : 8 + n])
        self.kind, docs = about["kind"], about["docs"]
        numbers = np.frombuffer(index, "<i8", offset=8 + n) if not (len(index) - 8 - n) % 8 else None
        if numbers is None:
            raise ValueError("broken index")
        self.doc_ids, self.valid, self.lengths = numbers[:docs], numbers[docs : 2 * docs] != 0, numbers[2 * docs : 3 * docs]
        self.chunks = numbers[3 * docs :].reshape(about["chunks"], -1) if about["chunks"] else np.zeros((0, 1), "<i8")
        self.starts = len(MAGIC) + np.concatenate([[0], np.cumsum(self.chunks[:, 1:].sum(1))]).astype(np.int64)

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        n, *sizes = self.chunks[k].tolist()
        held, unpack = self._at(int(self.starts[k]), sum(sizes)), zstandard.ZstdDecompressor()
        planes, at = [], 0
        for size in sizes:
            planes.append(unpack.decompress(held[at : at + size]) if size else b"")
            at += size
        return from_planes(planes, n, self.kind)

    def blocks(self) -> Iterator[np.ndarray]:
        for k in range(len(self.chunks)):
            yield self.block(k)


# ---------------------------------------------------------------- ids


class Encoder:
    """The ids of whole texts, by the tokenizers library, remembering those of pieces between spaces.

    Such a piece has the same ids alone as within its text, as this kind of tokenizer drops white space before it
    cuts words; so a text's ids are those of its pieces. A full stop or comma after a letter is cut off too, and ASCII
    is lowered, as the tokenizer does both itself. Only pieces that are not in the memory go to the tokenizer: of up to 16
    bytes one per slot, compared by all their bytes, longer ones in a dictionary. It is emptied when it holds `keep` ids.
    """

    SLOT_BITS = 20

    def __init__(self, path: str, keep: int = 6_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model, self.plain = self.tokenizer.model, re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@[-`{-~]*)")
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}  # the rule of byte-level vocabularies
        hidden = iter(range(256, 512))
        self.shown = {b: chr(b if b in shown else next(hidden)) for b in range(256)}
        self.tail_ids = np.zeros(256, "<u4")
        for tail in ".,":
            ids = self._whole(tail)
            if len(ids) != 1 or self._whole(f"Word{tail} \n{tail}") != [*self._whole("word"), *ids, *ids]:
                raise ValueError("this tokenizer keeps case or white space; its texts can't be cut at spaces")
            self.tail_ids[ord(tail)] = ids[0]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros((3, 1 << self.SLOT_BITS), np.uint64)  # the first and second 8 bytes, and how many in all
        self.at, self.length = np.zeros(1 << self.SLOT_BITS, np.int64), np.zeros(1 << self.SLOT_BITS, np.int64)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.arena, self.used = np.zeros(1 << 20, "<u4"), 0

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece(self, piece: str) -> list[int]:
        low = piece.lower()
        found = self.plain.fullmatch(low)
        if not found or len(low) != len(piece):
            return self._whole(piece)
        word, signs = found.groups()
        if not word.isascii():
            word = "".join([self.shown[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(word)]
        return ids + [t.id for t in self.model.tokenize(signs)] if signs else ids

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Appends the pieces' ids to the arena; where they begin and how many they are."""
        found = [self.piece(p) for p in pieces]
        length = np.fromiter(map(len, found), np.int64, len(found))
        at = self.used + np.cumsum(length) - length
        flat = np.fromiter(itertools.chain.from_iterable(found), "<u4", int(length.sum()))
        while self.used + len(flat) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros(len(self.arena), "<u4")])
        self.arena[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return at, length

    def encode(self, column: pa.LargeStringArray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts end to end, each text followed by end_id, and the number of ids of each text."""
        data, offsets = shared.raw(column)
        inside = ((data != 32) & (data != 10)).view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.searchsorted(start, offsets)
        if not len(start):
            n = len(column) if end_id is not None else 0
            return np.full(n, end_id or 0, "<u4"), np.full(len(column), n and 1, np.int64)
        odd = np.zeros(len(data) + 1, np.int32)
        np.cumsum(~_LETTER[data], out=odd[1:])
        last, before = data[end - 1], data[np.maximum(end - 2, 0)]
        letter = _ASCII_LETTER[before] | ((before >= 128) & (before != 0x97) & (before != 0xB7) & (data[np.maximum(end - 3, 0)] == 0xC3) & (end - start > 2))
        tail = ((last == 46) | (last == 44)) & (end - start > 1) & letter & (odd[np.maximum(end - 1, 0)] == odd[start])
        stop = end - tail
        low = _LOWER[data]
        size = stop - start
        short = size <= 16
        held = shared.chunks(low)
        key = np.zeros((3, len(start)), np.uint64)
        key[0], key[2] = shared.chunk(held, start, size), size
        two = np.flatnonzero(size > 8)
        key[1, two] = shared.chunk(held, start[two] + 8, size[two] - 8)
        slot = (shared.mix(shared.mix(key[0] + key[2]) ^ key[1]) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        special = np.flatnonzero(data == 60)  # "<" may begin a special token, whose case counts
        if len(special):
            short[np.searchsorted(start, special, "right") - 1] = False
        hit = short & (self.keys[:, slot] == key).all(0)
        at, length = self.at[slot], self.length[slot]
        miss = np.flatnonzero(short & ~hit)
        if len(miss):
            order = miss[np.lexsort(key[:, miss])]
            new = np.ones(len(order), bool)
            new[1:] = (key[:, order[1:]] != key[:, order[:-1]]).any(0)
            own, lowered = order[new], low.tobytes()
            new_at, new_length = self._learn([lowered[a:b].decode("utf-8", "replace") for a, b in zip(start[own].tolist(), stop[own].tolist())])
            back = np.cumsum(new) - 1
            at[order], length[order] = new_at[back], new_length[back]
            slots, one = np.unique(slot[own], return_index=True)  # of pieces that want the same slot one gets it
            self.keys[:, slots] = key[:, own[one]]
            self.at[slots], self.length[slots] = new_at[one], new_length[one]
        others = np.flatnonzero(~short).tolist()
        if others:
            lowered, exact = low.tobytes(), data.tobytes()
            pieces = [exact[a:b] if 60 in exact[a:b] else lowered[a:b] for a, b in zip(start[others].tolist(), stop[others].tolist())]
            unknown = list({p for p in pieces if p not in self.long})
            if unknown:
                where = self._learn([p.decode("utf-8", "replace") for p in unknown])
                self.long.update(zip(unknown, zip(*(w.tolist() for w in where))))
            places = np.array([self.long[p] for p in pieces])
            at[others], length[others] = places[:, 0], places[:, 1]
        # where each piece's ids go: after those of all pieces before it and one end id for each text before it
        ends = np.cumsum(length + tail)
        doc = np.repeat(np.arange(len(column)), np.diff(first))
        begin = ends - length - tail + (doc if end_id is not None else 0)
        shift = np.concatenate([[0], ends])
        per_text = shift[first[1:]] - shift[first[:-1]]
        extra = len(column) if end_id is not None else 0
        out = np.full(int(ends[-1]) + extra, end_id or 0, "<u4")
        steps = np.cumsum(length)
        along = np.arange(int(steps[-1]))
        out[along + np.repeat(begin - steps + length, length)] = self.arena[along + np.repeat(at - steps + length, length)]
        out[(begin + length)[tail]] = self.tail_ids[last[tail]]
        if self.used > self.keep:
            self._forget()
        return out, per_text + (end_id is not None)


_LETTER, _ASCII_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- DataFrames


def write_tokens(
    docs: DataFrame, tokenizer_path: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text",
    end_id: int | None = END_ID, kind: str = "bit", block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Encodes docs in ascending id order into files under folder; returns the manifest: part, path, n_docs, n_ids, n_bytes.

    One file per range of ids. A task writes under a name of its own and reports it in its output row; the manifest
    is written by Spark's committer, so files of failed or repeated attempts never count. folder must be reachable
    by pyarrow's file systems from every executor. Null texts are empty; null ids come first; rows with equal ids are
    ordered by text; an empty table gives an empty manifest; other columns are ignored.
    """
    if kind not in PLANES:
        raise ValueError(f"kind must be one of {sorted(PLANES)}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        part, out, encode = TaskContext.get().partitionId(), None, encoder(tokenizer_path)
        for batch in batches:
            column, ids = shared.texts(batch.column(1)), batch.column(0)
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            doc_ids = pc.fill_null(ids.cast(pa.int64()), 0).to_numpy()
            for a, b in shared.slices(column):
                if out is None:
                    system, base = fs.FileSystem.from_uri(folder)
                    system.create_dir(base, recursive=True)
                    path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.planes"
                    out = system.open_output_stream(path)
                    writer = Writer(out, kind, block_ids)
                found, lengths = encode.encode(column.slice(a, b - a), end_id)
                writer.add(doc_ids[a:b], valid[a:b], lengths, found)
        if out is not None:
            writer.close()
            n_docs, n_ids = sum(map(len, writer.lengths)), writer.n_ids
            out.close()
            size = system.get_file_info(path).size
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [size]},
                schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]),
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = chosen.repartitionByRange(F.col("id").asc()).sortWithinPartitions("id", "text")
    manifest = ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long, n_bytes long")
    spark = docs.sparkSession
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def n_tokens(text: Column, tokenizer_path: str, end_id: int | None = END_ID) -> Column:
    """How many ids each whole text has in the files, the end id included; null texts are empty."""

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            column, found = shared.texts(batch), [np.zeros(0, np.int64)]
            for a, b in shared.slices(column):
                found.append(encode.encode(column.slice(a, b - a), end_id)[1])
            yield pa.array(np.concatenate(found), pa.int64())

    return counted(text)


def read_runs(runs: DataFrame) -> DataFrame:
    """runs: path, at, n and any other columns; these with ids, the n ids from place at of the file on, in place of at and n.

    A file's runs are read by one task, in order; each block is unpacked once.
    """
    others = [c for c in runs.columns if c not in ("path", "at", "n")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        open_path, reader, source = None, None, None
        for batch in batches:
            out = []
            for path, at, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if path != open_path:
                    system, name = fs.FileSystem.from_uri(path)
                    source = system.open_input_file(name)
                    reader, open_path, held = Reader(source), path, (-1, None)
                    ends = np.cumsum(reader.chunks[:, 0])
                parts = []
                for k in range(int(np.searchsorted(ends, at, "right")), int(np.searchsorted(ends, at + n)) + 1):
                    if held[0] != k:
                        held = k, reader.block(k)
                    first = int(ends[k]) - len(held[1])
                    parts.append(held[1][max(at - first, 0) : at + n - first])
                out.append(np.concatenate(parts).astype(np.int64))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32), np.concatenate(out) if out else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], lists], [*others, "ids"])

    kind = T.StructType([runs.schema[c] for c in others] + [T.StructField("ids", T.ArrayType(T.LongType()))])
    ordered = runs.select("path", F.col("at").cast("long"), F.col("n").cast("long"), *others).repartition("path").sortWithinPartitions("path", "at")
    return ordered.mapInArrow(read, kind)


def read_tokens(manifest: DataFrame, *, with_ids: bool = False, with_place: bool = False) -> DataFrame:
    """Per document of the files of a manifest: doc_id, start, n_tokens, ids_crc32 and, if asked for, its file and the place of
    its ids in it (path, at), and its ids.

    start counts the ids of all documents before it, over all files; files are read in parallel.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as source:
                    reader = Reader(source)
                    yield from documents(reader, base or 0, path)

    def documents(reader: Reader, base: int, path: str) -> Iterator[pa.RecordBatch]:
        blocks, held = reader.blocks(), np.zeros(0, "<u4")
        starts = base + np.concatenate([[0], np.cumsum(reader.lengths)])
        for first in range(0, len(reader.lengths), 5000):
            some = slice(first, first + 5000)
            crcs, lists = [], []
            for n in reader.lengths[some].tolist():
                crc, kept = 0, []
                while n:
                    if not len(held):
                        held = next(blocks)
                    now, held = held[:n], held[n:]
                    n -= len(now)
                    crc = zlib.crc32(now.tobytes(), crc)
                    if with_ids:
                        kept.append(now)
                crcs.append(crc)
                lists.append(np.concatenate(kept) if kept else np.zeros(0, "<u4"))
            columns = [
                pa.array(reader.doc_ids[some], pa.int64(), mask=~reader.valid[some]),
                pa.array(starts[:-1][some], pa.int64()),
                pa.array(reader.lengths[some], pa.int64()),
                pa.array(crcs, pa.int64()),
            ]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_place:
                columns += [pa.array([path] * len(crcs), pa.string()), pa.array(starts[:-1][some] - base, pa.int64())]
                names += ["path", "at"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int64) for x in lists], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    n_files = max(1, manifest.count())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.select("path", F.sum("n_ids").over(before).alias("base")).repartition(n_files)
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", path string, at long" * with_place + ", ids array<bigint>" * with_ids
    return placed.mapInArrow(read, kind)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents into bit-plane files and gives each document's place and checksum as read back."""
    import public_tokenizers

    folder = shared.shared_path(spark, "tokens")
    manifest = write_tokens(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_tokens(manifest)
