"""Token ids in binary files of independent zstandard frames.

A file holds one frame a document (its ids as little-endian unsigned 32-bit
integers, with zstandard's content checksum), then a seek table with one entry
a frame (document id, offset, compressed size, number of ids, crc32 of the
ids), then a footer that says where the table is. A reader fetches the footer
and the table and decompresses only the documents asked for.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memory, new_dir

MAGIC = b"GWTOKFR1"
ENTRY = np.dtype([("doc_id", "<i8"), ("null_id", "<u4"), ("size", "<u4"), ("offset", "<u8"), ("n_tokens", "<u4"), ("crc32", "<u4")])
FOOTER = np.dtype([("table_offset", "<u8"), ("frames", "<u8"), ("table_crc32", "<u4"), ("version", "<u4"), ("magic", "S8")])
LEVEL = 3
CHARS_PER_FILE = 16_000_000
KNOWN = 500_000          # pieces of text in a generation of those remembered
PART = 500_000           # characters encoded at a time
TOGETHER = 4_000         # pieces handed to the library as one text

# White space as the byte-level pre-tokenizer sees it. Its pieces never reach
# from a non-space into a space, nor from a letter into a mark, so a run of
# white space with the non-space characters after it, or with the letters up to
# a mark, can be encoded on its own.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
SPACES = frozenset(filter(re.compile(f"[{SPACE}]").match, map(chr, range(0x3001))))
PIECES = re.compile(f"[{SPACE}]*+(?:[{LETTER}]++(?:(?=[.,;:!?()\"%$*#&|/])|[^{SPACE}]*+)|[^{SPACE}]++)|[{SPACE}]++")


class Encoder:
    """Whole texts to little-endian ids. Pieces of text are encoded by the
    tokenizers library once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known = Memory(KNOWN)
        # bytes of text that each token stands for: the vocabulary writes a byte as one character
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(token)

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        part, held = [], 0
        for t in texts:
            part.append(t)
            held += len(t or "")
            if held >= PART:
                yield from self._whole(part)
                part, held = [], 0
        yield from self._whole(part)

    def _whole(self, part: list[str | None]) -> Iterator[bytes]:
        return map(b"".join, self.known.recall((PIECES.findall(t) if t else [] for t in part), self._encode))

    def _encode(self, new: list[str]) -> dict[str, bytes]:
        """Ids of each piece. A piece that begins with white space and ends
        without it is a piece of any text that it stands in after another
        such, so they are encoded as one text; their bytes say where one's
        tokens end. The others are encoded one by one."""
        out: dict[str, bytes] = {}
        whole, rest = [], []
        for p in new:
            (whole if p[0] in SPACES and p[-1] not in SPACES else rest).append(p)
        for lo in range(0, len(whole), TOGETHER):
            part = whole[lo:lo + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            upto = np.cumsum(self.size[ids])
            ends = np.cumsum(list(map(len, map(str.encode, part))))
            cuts = np.searchsorted(upto, ends, side="right")
            if not np.array_equal(upto[cuts - 1], ends):
                raise ValueError("tokens do not end where pieces do")
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            out.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[p] = np.array(e.ids, "<u4").tobytes()
        return out


_ENCODERS: dict[str, Encoder] = {}       # of this worker process


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _framer(path: str, end_id: int, bounds: list[int]):
    tail, cuts = np.uint32(end_id).astype("<u4").tobytes(), np.array(bounds, np.int64)

    @F.pandas_udf("file int, n_tokens long, crc32 long, frame binary")
    def frames(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        for ids, texts in batches:
            out = [x + tail for x in _encoder(path)(texts)]
            at = np.where(ids.isna(), 0, np.searchsorted(cuts, ids.fillna(0).astype("int64"), side="right"))
            yield pd.DataFrame({"file": at.astype("int32"), "n_tokens": [len(x) // 4 for x in out],
                                "crc32": [zlib.crc32(x) for x in out], "frame": [pack.compress(x) for x in out]})
    return frames


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pafs.FileSystem.from_uri(folder)
        number, sink, entries, name, at = None, None, [], "", 0

        def close() -> pd.DataFrame:
            table = np.array(entries, ENTRY).tobytes()
            foot = np.array([(at, len(entries), zlib.crc32(table), 1, MAGIC)], FOOTER).tobytes()
            sink.write(table + foot)
            sink.close()
            return pd.DataFrame({"file": [number], "name": [name], "n_docs": [len(entries)], "file_tokens": [int(sum(e[4] for e in entries))]})
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.file != number:
                    if sink is not None:
                        yield close()
                    # each attempt writes a file of its own; only the manifest makes it part of the output
                    number, entries, at = row.file, [], len(MAGIC)
                    name = f"tokens-{number:06d}-{uuid.uuid4().hex}.bin"
                    sink = store.open_output_stream(f"{root}/{name}")
                    sink.write(MAGIC)
                sink.write(row.frame)
                null = pd.isna(row.doc_id)
                entries.append((0 if null else int(row.doc_id), int(null), len(row.frame), at, row.n_tokens, row.crc32))
                at += len(row.frame)
        if sink is not None:
            yield close()
    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 chars_per_file: int = CHARS_PER_FILE) -> DataFrame:
    """Encode whole texts, end each document with ``end_id`` and write the ids
    to ``folder`` in ascending id order. Returns the manifest: file (number in
    that order), name, n_docs, file_tokens; it is written to
    ``folder``/manifest too.

    Documents are dealt to files by quantiles of the id, so only compressed
    frames are shuffled and each task writes whole files. A rerun task writes
    under a new name; files that no manifest row names are removed.

    Null or empty text: only the end id. Null ids come first. Repeated ids
    stay, ordered by their ids' count and checksum. Other columns are not
    read. Empty table: no file, empty manifest."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1)).first()[0] or 0
    n = max(1, -(-chars // chars_per_file))
    bounds = []
    if n > 1:
        cut = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
        bounds = sorted({b + 1 for b in cut or []})
    framed = rows.select("doc_id", _framer(tokenizer, end_id, bounds)("doc_id", "text").alias("f")).select("doc_id", "f.*")
    dealt = framed.repartitionById(len(bounds) + 1, F.col("file")).sortWithinPartitions("file", F.asc_nulls_first("doc_id"), "n_tokens", "crc32")
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    made = dealt.mapInPandas(_writer(folder), "file int, name string, n_docs long, file_tokens long")
    made.write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(made.schema).parquet(f"{folder}/manifest")
    named = {r[0] for r in manifest.select("name").collect()}
    for info in store.get_file_info(pafs.FileSelector(root)):
        if info.is_file and info.base_name.endswith(".bin") and info.base_name not in named:
            store.delete_file(info.path)
    return manifest


def read_table(f) -> np.ndarray:
    """The seek table of an open file, checked."""
    end = f.size()
    foot = np.frombuffer(f.read_at(FOOTER.itemsize, end - FOOTER.itemsize), FOOTER)[0]
    if foot["magic"] != MAGIC:
        raise ValueError("not a token file")
    data = f.read_at(int(foot["frames"]) * ENTRY.itemsize, int(foot["table_offset"]))
    if zlib.crc32(data) != foot["table_crc32"]:
        raise ValueError("damaged seek table")
    return np.frombuffer(data, ENTRY)


def read_frame(f, entry, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    """The ids of one document, checked against the table's crc32."""
    raw = unpack.decompress(f.read_at(int(entry["size"]), int(entry["offset"])))
    if zlib.crc32(raw) != entry["crc32"] or len(raw) != 4 * int(entry["n_tokens"]):
        raise ValueError(f"damaged frame of document {entry['doc_id']}")
    return np.frombuffer(raw, "<u4")


def _reader(folder: str, wanted: frozenset | None, with_ids: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pafs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        for pdf in batches:
            for file_start, name in zip(pdf.file_start, pdf.name, strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    entries = read_table(f)
                    before = np.concatenate([[0], np.cumsum(entries["n_tokens"], dtype=np.int64)])[:-1]
                    pick = [i for i, e in enumerate(entries) if wanted is None or (not e["null_id"] and int(e["doc_id"]) in wanted)]
                    for lo in range(0, len(pick), 1000):
                        part = pick[lo:lo + 1000]
                        ids = [read_frame(f, entries[i], unpack) for i in part]
                        out = {"doc_id": pd.array([None if entries[i]["null_id"] else int(entries[i]["doc_id"]) for i in part], "Int64"),
                               "start": int(file_start) + before[part], "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]}
                        if with_ids:
                            out["ids"] = [x.astype(np.int64) for x in ids]
                        yield pd.DataFrame(out)
    return read


def read_tokens(spark: SparkSession, folder: str, doc_ids: Iterable[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of a folder written by :func:`write_tokens`: doc_id, start
    (ids of all documents before it), n_tokens, ids_crc32 (of what was read)
    and, ``with_ids``, the ids. With ``doc_ids`` only those are decompressed."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    n = max(1, manifest.count())
    # one row a file: where each begins is known before it is opened
    files = manifest.select("file", "name", (F.sum("file_tokens").over(Window.orderBy("file")) - F.col("file_tokens")).alias("file_start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    wanted = None if doc_ids is None else frozenset(int(i) for i in doc_ids)
    return files.repartitionById(n, F.col("file")).mapInPandas(_reader(folder, wanted, with_ids), schema)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Write the documents' ids to a new folder in the shared folder and read
    all of them back (without the ids)."""
    folder = new_dir(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer, end_id, **options)
    return read_tokens(docs.sparkSession, folder, with_ids=False)


