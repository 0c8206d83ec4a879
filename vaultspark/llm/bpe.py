"""Byte-level BPE: global distinct-word encoding, and decoding through the token-byte table.

1. Cut. Every text is cut into pre-tokens. A task gathers texts to chunks of bounded size; in a chunk each distinct pre-token has a number, and a text becomes the
   numbers of its pre-tokens in the order of their positions. So a pre-token is exploded once a chunk, not once an occurrence.
2. Encode. The chunks' pre-tokens meet in one global shuffle by word, where each distinct word is encoded once; its ids go to all chunks that hold it.
3. Reassemble. The ids of a chunk's words and the numbers of its texts meet by chunk, and every text is put together by position.

What is shuffled is packed: a chunk's words by hash of the word, in buckets, and their ids by chunk. A task holds the words of one bucket at a time; there are eight buckets for each
shuffle partition, so they stay small however large the vocabulary. A word has a row for each chunk that holds it, however often it occurs: a frequent word's share grows with the
number of chunks, not of occurrences. No dictionary passes through the driver. The chunks are dealt once, and both their words and their texts are read from that one shuffle; a
task that runs again makes the same chunks, as it reads the same rows of a table in the same order (docs that are not read from a table are written to one first). Decoding joins the
ids to the token-byte table, whose size the vocabulary fixes.

Defined results: a null text is empty: no ids, and empty bytes. Text is never cut short; a word of any length is merged with a heap, and a text longer than a
chunk is a chunk of its own. Repeated rows are each encoded. An empty table gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_columns, materialise, pieces, struct_of, tidy


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank in each line. Read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of lowest rank, leftmost first, is merged until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    live = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or after[i] >= n or end[after[i]] != stop:
            continue  # a part of it has been merged otherwise
        j = after[i]
        live[j], after[i], end[i] = False, after[j], stop
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


@lru_cache(maxsize=4)
def _cutter(pattern: str):
    import regex

    return regex.compile(pattern)


class _Numbers(dict):
    """The number of each distinct word, in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


#: Longer texts are cut match by match, not into one list.
LONG_TEXT = 1 << 20
#: Bytes of ids in a batch of the result.
OUT_BYTES = 2 << 20
CUT = "chunk long, bucket int, n long, doc_ids array<bigint>, sizes array<int>, packed binary"


def _pack(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of non-negative numbers, of equal length, as planes of bytes, and a tail, compressed: small numbers take little."""
    return pa.compress(b"".join([*(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns), tail]), codec="zstd", asbytes=True) + sum(map(len, columns)).to_bytes(8, "little") + len(tail).to_bytes(8, "little")


def _unpack(raw: bytes, *lengths: int) -> tuple[list[np.ndarray], bytes]:
    """The columns, whose lengths are known, and the tail."""
    total, tail = int.from_bytes(raw[-16:-8], "little"), int.from_bytes(raw[-8:], "little")
    data = pa.decompress(raw[:-16], decompressed_size=4 * total + tail, codec="zstd", asbytes=True)
    out, at = [], 0
    for n in lengths:
        planes = np.frombuffer(data, np.uint8, 4 * n, at)
        out.append(np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64))
        at += 4 * n
    return out, data[at : at + tail]


def cut(docs: DataFrame, pattern: str, chunk_chars: int, chunk_words: int, buckets: int) -> DataFrame:
    """Rows (chunk, n, doc_ids, sizes, numbers) of n texts each, sizes being how many numbers a text has, and rows (chunk, bucket, n, numbers and words) of the distinct pre-tokens
    of a chunk. A chunk ends with the text that brings it to chunk_chars characters or chunk_words distinct pre-tokens."""
    out = to_arrow_schema(struct_of(CUT))

    def rows(**columns: list) -> pa.RecordBatch:
        n = max(map(len, columns.values()))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), type=f.type) for f in out], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, chunk = _cutter(pattern), TaskContext.get().partitionId() << 32
        numbers, held = _Numbers(), 0

        def words() -> Iterator[pa.RecordBatch]:
            every = list(numbers)
            bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in every), np.int32, len(every))
            order = np.argsort(bucket, kind="stable")
            made: dict[str, list] = {"chunk": [], "bucket": [], "n": [], "packed": []}
            for codes in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if every else ():
                some = sorted((every[c].encode(), c) for c in codes.tolist())  # side by side like begins with like
                made["chunk"].append(chunk)
                made["bucket"].append(bucket[codes[0]])
                made["n"].append(len(some))
                made["packed"].append(_pack(np.array([c for _, c in some]), np.array([len(w) for w, _ in some]), tail=b"".join(w for w, _ in some)))
            if every:
                yield rows(**made)

        def texts() -> Iterator[pa.RecordBatch]:
            if ids:
                yield rows(chunk=[chunk], n=[len(ids)], doc_ids=[ids], sizes=[list(map(len, found))], packed=[_pack(np.concatenate(found))])

        for batch in (p for b in batches for p in pieces(b)):
            ids, found = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                said = compiled.findall(text) if text and len(text) < LONG_TEXT else (m[0] for m in compiled.finditer(text or ""))
                found.append(np.fromiter(map(numbers.__getitem__, said), np.uint32))
                ids.append(doc_id)
                held += len(text or "")
                if held >= chunk_chars or len(numbers) >= chunk_words:
                    yield from texts()
                    yield from words()
                    chunk, numbers, held, ids, found = chunk + 1, _Numbers(), 0, [], []
            yield from texts()
        ids = []
        yield from words()

    return docs.mapInArrow(tidy(run), CUT)


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(chunk, n, numbers, how many ids each has, and the ids) of (chunk, bucket, n, numbers and words): all rows of a word lie in one bucket, whose words are held while it is
    worked on, so that each is encoded once."""
    held = words.sparkSession.sparkContext.broadcast(ranks)
    out = to_arrow_schema(struct_of(IDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = held.value, None
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            made: tuple[list, list, list] = [], [], []
            for chunk, bucket, n, raw in zip(*(batch[c].to_pylist() for c in ("chunk", "bucket", "n")), batch["packed"], strict=True):
                if bucket != at:
                    at, known = bucket, {}
                (codes, sizes), tail = _unpack(raw.as_py(), n, n)
                ends, lists = np.cumsum(sizes).tolist(), []
                for a, b in zip([0, *ends], ends, strict=False):
                    word = tail[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(merge_word(word, table), "<u4")
                    lists.append(ids)
                made[0].append(chunk)
                made[1].append(n)
                made[2].append(_pack(codes, np.fromiter(map(len, lists), np.int64, n), np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, out, strict=True)], schema=out)

    return words.select("chunk", "bucket", "n", "packed").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), IDS)


IDS = "chunk long, n long, packed binary"
SCHEMA = "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk_chars: int = 32_000_000, chunk_words: int = 1 << 19, buckets: int | None = None, decoded: bool = False) -> DataFrame:
    """One row per document: its ids, as little-endian unsigned 32-bit integers, and their number; with `decoded` also what decode gives of them, in the same pass.
    Words are dealt to so many buckets; by default to eight for each shuffle partition, 256 at least."""
    spark = docs.sparkSession
    buckets = buckets or max(256, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plan = slim._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "FileScan" not in plan:
        slim = materialise(spark, slim, "bpe-texts")
    dealt = cut(slim, pattern, chunk_chars, chunk_words, buckets).repartition("chunk")


    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in Python, as a condition would be moved below the shuffle, and there would be two
        for batch in batches:
            yield batch.filter(batch["bucket"].is_valid())

    ids = encode_words(dealt.mapInArrow(tidy(of_words), CUT), ranks)
    schema = SCHEMA + ", decoded binary" if decoded else SCHEMA
    out = to_arrow_schema(struct_of(schema))
    known = spark.sparkContext.broadcast(token_bytes(ranks)) if decoded else None

    def reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
        parts = []
        for n, raw in zip(words["n"].to_pylist(), words["packed"].to_pylist(), strict=True):
            parts.append(_unpack(raw, n, n, int.from_bytes(raw[-16:-8], "little") - 2 * n)[0])
        code, n, flat = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        begin, length = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        begin[code], length[code] = np.cumsum(n) - n, n  # where the ids of each number begin in one array of all, and how many they are
        flat = flat.astype("<u4")
        texts, made, done, waiting = texts.filter(texts["bucket"].is_null()), [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True) if made else [()] * len(out), out, strict=True)], schema=out)

        for ids, sizes, raw in zip(*(texts[c] for c in ("doc_ids", "sizes", "packed")), strict=True):
            each = sizes.as_py()
            codes = _unpack(raw.as_py(), sum(each))[0][0]
            for doc_id, at, n in zip(ids.as_py(), np.cumsum([0, *each]).tolist(), each, strict=False):
                mine = codes[at : at + n]
                many = length[mine]
                ends = np.cumsum(many)
                row = flat[np.repeat(begin[mine] - ends + many, many) + np.arange(ends[-1] if n else 0)].tobytes()
                made.append((doc_id, len(row) // 4, row, *(_decoded([row], known.value) if decoded else ())))
                waiting += len(row)
                if waiting > OUT_BYTES:
                    done.append(batch())
                    made, waiting = [], 0
        return pa.Table.from_batches([*done, batch()], schema=out)

    return dealt.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(reassemble, schema)


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table, by id; an id that no token has stands for no bytes."""
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _decoded(ids: list[bytes], table: list[bytes]) -> list[bytes]:
    return [b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in ids]


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows of encode with a further column `decoded`: the bytes that the ids stand for."""
    held = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks))

    def start():
        return lambda cols: cols | {"decoded": _decoded(cols["ids"], held.value)}

    return map_columns(encoded.select("doc_id", "n_tokens", "ids"), SCHEMA + ", decoded binary", start)
