"""N-gram Jaccard join: all links between texts whose sets of word shingles agree in at least num/den of their union, by T-occurrence search.

1. Classes. Texts of one shingle set form a class; only classes are joined, so copies cost nothing further.
2. Lists. A set of n shingles that links with another shares at least T = ceil(n * num / den) of them, so in any one order of all shingles
   two linked sets meet among their first n - T + 1: the short lists; the rest are the long ones, which need not be gone through. The
   order is: rarer first, by a sketch of shingle counts over the whole corpus (a fixed number of counters, whatever the input), then by hash.
   A wrong count can only lengthen lists, never lose a link.
3. Candidates. Lists of one member go, and of lists with the same members one stays. The classes of a list are compared by signatures: bit b of a set's is the
   parity of its shingles that fall on b, so two signatures differ in at most as many bits as their sets in shingles; pairs that
   differ in more than a link allows are no candidates. A list that is too heavy for a task is cut, and every pair of its parts is a task. No pair is
   compared whose ends are known to hang together in the list, so a group of near copies gives about one pair a member.
4. Search. Candidate pairs form components, which are groups of near copies or nearly so: nothing is joined that hasn't passed the signatures. Within a component
   DivideSkip runs on the whole sets: the short lists are merged through a heap, what occurs often enough
   there is looked up in the long lists by binary search, and classes that reach the overlap of their sizes are linked. Once the members
   are known to hang together no further pair is looked at. A component heavier than a block is first cut by size, into overlapping pairs of bands; where such a part still takes
   several blocks, its least class is compared with all members first, and only those that don't link with it are then searched for in every block.
5. Components of the links, spread to all members of the classes.

Words are runs without white space, A-Z in lower case. Shingles are 64-bit hashes; classes are 128-bit digests of whole sorted sets.

Defined results: a null text or one without words has an empty set and links with nothing, not even its like. A text of fewer words than a
shingle has one shingle, all of it. Repeated rows are members of one class. A null doc_id never names a component unless all of its
members have none. An empty table gives an empty result. Texts of any length are read whole. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Workspace, broadcast_if_small, map_columns, materialise, pieces, struct_of, tidy
from .components import components

SLOT_BITS = 22
_PIECE_BITS = 16

# --- shingles ---

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_P = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for p in (_P, pow(_P, -1, 1 << 64)):
            t = np.full(m, np.uint64(p))
            t[0] = 1
            both.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = both
    return _powers[0], _powers[1]


_CHARS = _mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word of a text's UTF-8 bytes, in order."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    turn = np.diff(inside)
    start, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CHARS[_LOWER[raw]] * up[: len(raw)], out=total[1:])
    return _mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * _STEP)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    w = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    k = min(k, len(w))
    x = np.full(len(w) - k + 1, np.uint64(k))
    for j in range(k):
        x = _mix(x * _STEP + w[j : len(w) - k + 1 + j])
    return np.unique(x)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def ceil_ratio(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def needed(n: int, m: int, num: int, den: int) -> int:
    """The overlap that sets of n and m shingles need: I / (n + m - I) >= num / den."""
    return -(-num * (n + m) // (num + den))


def allowed(n: int, m: int, num: int, den: int) -> int:
    """How many shingles linked sets of n and m may not share."""
    return n + m - 2 * needed(n, m, num, den)


def signature(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Parities of the numbers of shingles by their last bits, packed. Three times as many bits as linked sets may differ in, as unrelated sets differ in half of
    them: a power of two, so that a longer signature folds to a shorter."""
    bits = max(64, 1 << (3 * allowed(len(s), len(s), num, den) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    """A signature of so many words of 64 bits."""
    return np.bitwise_xor.reduce(sig.reshape(-1, words), axis=0)


def alike(sizes: np.ndarray, sigs: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of members of a list whose signatures allow a link, enough of them to connect all that such pairs connect."""
    n = len(sizes)
    width = np.array([len(x) for x in sigs])
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    label, found = np.arange(n), []
    for w in np.unique(width).tolist():  # all that are at least so wide
        of = np.flatnonzero(width >= w)
        tables[w] = of, np.stack([folded(sigs[k], w) for k in of])
    hub = 0
    for x in range(n):
        big = label == label[hub]
        if big.sum() * 2 > n and big[x]:
            continue  # two that aren't connected yet have one outside the largest, which compares itself with all
        for w, (of, table) in tables.items():
            if w > width[x]:
                continue
            mine = label[of] != label[x]
            if w < width[x]:
                mine &= width[of] == w  # wider ones are compared at the full width of x
            mine &= (np.minimum(sizes[of], sizes[x]) * den >= num * np.maximum(sizes[of], sizes[x]))
            at = np.flatnonzero(mine)
            if not len(at):
                continue
            both = sizes[of[at]] + sizes[x]
            differ = np.bitwise_count(table[at] ^ folded(sigs[x], w)).sum(axis=1, dtype=np.int64)
            for y in of[at[differ <= both - 2 * (-(-num * both // (num + den)))]].tolist():
                if label[y] != label[x]:
                    found.append((x, y))
                    label[label == label[y]] = label[x]
        if (label == label[x]).sum() > (label == label[hub]).sum():
            hub = x
    return found


# --- T-occurrence search within a block ---


def heap_merge(lists: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """(document, occurrences) of documents in at least `least` of the sorted lists."""
    plain = [x.tolist() for x in lists if len(x)]
    heap = [(x[0], k, 0) for k, x in enumerate(plain)]
    heapq.heapify(heap)
    out: list[tuple[int, int]] = []
    at, n = -1, 0
    while heap:
        doc, k, i = heap[0]
        if doc != at:
            if n >= least:
                out.append((at, n))
            at, n = doc, 0
        n += 1
        if i + 1 < len(plain[k]):
            heapq.heapreplace(heap, (plain[k][i + 1], k, i + 1))
        else:
            heapq.heappop(heap)
    if n >= least:
        out.append((at, n))
    return out


def block_links(sets: list[np.ndarray], asks: list[bool], num: int, den: int, mu: float = 0.0085) -> list[tuple[int, int]]:
    """Links between sets, one of each asking, that together connect all that the links between them connect: a spanning forest of them."""
    all_ask = all(asks)
    n = len(sets)
    sizes = [len(s) for s in sets]
    label, links = np.arange(n), []
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    tokens, token = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True)
    codes = np.sort(token.astype(np.int64) * n + owner)  # the lists, one after the other, each sorted
    docs = codes % max(1, n)
    ends = np.searchsorted(codes, (np.arange(len(tokens), dtype=np.int64) + 1) * n)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    lengths = ends - starts
    begin = np.concatenate([[0], np.cumsum(sizes)])
    hub, hubs = 0, 1
    for x in (x for x in range(n) if asks[x]):
        if hubs == n:
            break
        # a link between two components has an end outside the largest; all that ask are outside it or were asked before it grew
        if all_ask and hubs > n // 2 and label[x] == label[hub]:
            continue
        own = token[begin[x] : begin[x + 1]]
        own = own[lengths[own] > 1]
        t = ceil_ratio(sizes[x], num, den)
        if len(own) < t:
            continue
        own = own[np.argsort(lengths[own], kind="stable")]
        # of the longest lists at most t - 1 are only looked up
        skip = min(t - 1, int(t / (mu * np.log2(max(2, int(lengths[own[-1]]))) + 1)))
        short, long = own[: len(own) - skip], own[len(own) - skip :]
        # what hangs together with x already need not be merged
        lists = [(part := docs[starts[k] : ends[k]])[label[part] != label[x]] for k in short.tolist()]
        for y, seen in heap_merge(lists, max(1, t - skip)):
            if label[x] == label[y]:
                continue
            must = needed(sizes[x], sizes[y], num, den)
            if seen + len(long) < must or min(sizes[x], sizes[y]) * den < num * max(sizes[x], sizes[y]):
                continue
            code = long.astype(np.int64) * n + y
            at = np.searchsorted(codes, code)
            got = seen + int((codes[np.minimum(at, len(codes) - 1)] == code).sum())
            if got >= must:
                label[label == label[y]] = label[x]
                links.append((x, y))
        if (mine := int((label == label[x]).sum())) > hubs or label[x] == label[hub]:
            hub, hubs = x, mine
    return links


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    return len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y), num, den)


# --- in Spark ---


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _first_pass(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Rows (doc_id, h, row, n_shingles, digest, sig), h the text's hash, and from each task rows (piece, counts) of its part of the sketch, in counters that stop at 255."""
    schema = "doc_id long, h long, row long, n_shingles long, digest binary, sig binary, piece int, counts binary"
    out = to_arrow_schema(struct_of(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, waiting = np.zeros(1 << SLOT_BITS, np.uint8), [], 0

        def add() -> None:
            slots, n = np.unique(np.concatenate(held), return_counts=True)
            counts[slots] = np.minimum(255, counts[slots] + n)

        for batch in (p for b in batches for p in pieces(b)):
            n, d, sigs = [], [], []
            for text in batch["text"].to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                d.append(digest(s))
                sigs.append(signature(s, num, den).tobytes())
                held.append(_slots(s))
                waiting += len(s)
                if waiting > 500_000:
                    add()
                    held.clear()
                    waiting = 0
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], batch["row"], pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(sigs, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], schema=out)
        if held:
            add()
        width = 1 << _PIECE_BITS
        for p in range(1 << (SLOT_BITS - _PIECE_BITS)):
            piece = counts[p * width : (p + 1) * width]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 4 + [pa.array([None], pa.binary())] * 2 + [pa.array([p], pa.int32()), pa.array([piece.tobytes()], pa.binary())], schema=out)

    return docs.mapInArrow(tidy(run), schema)


def _rarity(pieces: DataFrame) -> np.ndarray:
    """By slot a measure of its count, up to 255. What reaches the driver is one counter a slot, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch["piece"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                got = np.frombuffer(raw, np.uint8 if len(raw) == 1 << _PIECE_BITS else np.uint32).astype(np.uint32)
                sums[p] = sums[p] + got if p in sums else got
        for p, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["piece", "counts"])

    total = np.zeros(1 << SLOT_BITS, np.uint32)
    width = 1 << _PIECE_BITS
    # first within each task, then by piece: no task holds more than one counter a slot
    summed = pieces.mapInArrow(tidy(add), "piece int, counts binary").repartition("piece").mapInArrow(tidy(add), "piece int, counts binary")
    for row in summed.toLocalIterator():
        total[row["piece"] * width : (row["piece"] + 1) * width] += np.frombuffer(row["counts"], np.uint32)
    # a shingle of one text has what chance gives its slot, so among equals the emptier slot is the surer; steps of a quarter of chance's spread
    mean = float(total.mean())
    spread = max(1.0, mean**0.5)
    out = np.empty(len(total), np.uint8)
    for at in range(0, len(total), width):
        out[at : at + width] = np.clip((total[at : at + width] - max(0.0, mean - 6 * spread)) / max(1.0, spread / 4), 0, 255)
    return out


def classes_and_links(docs: DataFrame, k: int, num: int, den: int, block: int = 1_500_000, list_bytes: int = 8 << 20, max_broadcast: int = 300_000, row_col: str | None = None, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows (doc_id, h, row, n_shingles, digest) of each document, row being its row_col if one is named; links (a, b) between classes, enough of them to connect all that links connect."""
    spark = docs.sparkSession
    work = work or Workspace(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"))
    both = work.table(_first_pass(slim, k, num, den), "ngram-sets")
    rows = both.where("piece is null").select("doc_id", "h", "row", "n_shingles", "digest")
    rarity = spark.sparkContext.broadcast(_rarity(both.where("piece is not null").select("piece", "counts")))

    def short_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, done = rarity.value, set()
        for batch in (p for b in batches for p in pieces(b)):
            tokens, owners, sizes = [], [], []
            for text in batch["text"].to_pylist():
                s = shingle_set(text, k)
                d = digest(s)
                first = len(s) - ceil_ratio(len(s), num, den) + 1
                if not len(s) or d in done or len(s) * (den - num) * 2 < num + den and len(s) * den < num * (len(s) + 1):
                    continue  # seen in this task; or so small that only equal sets link
                if len(done) < 100_000:
                    done.add(d)
                kept = s[np.lexsort((s, classes[_slots(s)]))[:first]]
                tokens.append(kept.view(np.int64))
                owners += [d] * len(kept)
                sizes.append(np.full(len(kept), len(s), np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(owners, pa.binary()), pa.array(np.concatenate(sizes))], names=["token", "digest", "size"])

    lists = slim.mapInArrow(tidy(short_lists), "token long, digest binary, size int")
    order = Window.partitionBy("token").orderBy("size", "digest")
    near = lists.withColumns({f"{c}_{side}": f(c).over(order) for side, f in (("before", F.lag), ("after", F.lead)) for c in ("digest", "size")})
    # what has nothing of a fitting size beside it has none in its list; copies of a class from several tasks lie side by side
    fits = lambda low, high: F.col(low).cast("long") * den >= F.col(high).cast("long") * num
    before = (F.col("digest_before") != F.col("digest")) & fits("size_before", "size")
    after = (F.col("digest_after") != F.col("digest")) & fits("size", "size_after")
    met = near.where(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).select("token", "digest").distinct()
    met = work.table(met, "ngram-lists")
    rarity.destroy()
    sigs = both.where("n_shingles > 0").select("digest", "n_shingles", "sig").dropDuplicates(["digest"])
    pairs = work.table(_candidates(met, sigs, num, den, list_bytes, work), "ngram-candidates")
    work.drop("ngram-lists", "ngram-members-of-lists", "ngram-heavy-lists")
    links = _search(slim, rows, pairs, k, num, den, block, max_broadcast, work)
    work.drop(*work.paths.keys() - {"ngram-sets", "ngram-links"})
    return rows, links


def _candidates(met: DataFrame, sigs: DataFrame, num: int, den: int, list_bytes: int, work: Workspace) -> DataFrame:
    """Pairs (a, b) of classes that meet in a list and whose signatures allow a link, enough of them to connect all that such pairs connect."""
    one = met.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "digest")).alias("y"))
    # lists of the same members: the number and two hashes of 64 bits of their members agree
    kept = one.where("n > 1").groupBy("n", "x", "y").agg(F.min("token").alias("token")).select(F.col("token").alias("kept"))
    members = work.table(met.join(kept, F.col("token") == F.col("kept"), "left_semi").join(sigs, "digest"), "ngram-members-of-lists")
    weight = members.groupBy("token").agg(F.sum(F.octet_length("sig") + 64).alias("weight")).where(F.col("weight") > list_bytes).select("token", F.ceil(F.col("weight") / list_bytes).cast("int").alias("parts"))
    heavy, _ = broadcast_if_small(work.table(weight, "ngram-heavy-lists"), 100_000)
    light = members.join(heavy, "token", "left_anti").withColumns({"i": F.lit(0), "j": F.lit(0)})
    part = F.pmod(F.xxhash64(F.lit(2), "digest"), F.col("parts")).cast("int")
    cut = members.join(heavy, "token").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.where("parts > 1").withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    columns = ["token", "i", "j", "digest", "n_shingles", "sig"]
    out = to_arrow_schema(struct_of("a binary, b binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, sizes, held = None, [], [], []

        def done() -> pa.RecordBatch:
            found = alike(np.array(sizes), [np.frombuffer(x, np.uint64) for x in held], num, den)
            return pa.RecordBatch.from_arrays([pa.array([names[k] for k in side], pa.binary()) for side in (zip(*found, strict=True) if found else ((), ()))], schema=out)

        for batch in (p for b in batches for p in pieces(b)):
            for *key, name, size, sig in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if key != at and names:
                    yield done()
                    names, sizes, held = [], [], []
                at = key
                names.append(name)
                sizes.append(size)
                held.append(sig)
        if names:
            yield done()

    dealt = light.select(columns).union(cut.select(columns)).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return forest(dealt.mapInArrow(tidy(run), "a binary, b binary"))


def _sets_of(docs: DataFrame, who: DataFrame, k: int, max_broadcast: int) -> DataFrame:
    """(digest, label, weight, shingles): each class of `who` with the set of a text of its. The classes' rows go to the texts, not the texts to them, if they are few."""
    few, _ = broadcast_if_small(who.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "digest", "label", "weight"), max_broadcast)

    def start():
        def apply(cols):
            sets = [shingle_set(t, k) for t in cols["text"]]
            same = [i for i, s in enumerate(sets) if digest(s) == cols["digest"][i]]
            return {c: [cols[c][i] for i in same] for c in ("digest", "label", "weight")} | {"shingles": [sets[i].view(np.int64) for i in same]}

        return apply

    return map_columns(docs.join(few, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("text", "digest", "label", "weight"), "digest binary, label binary, weight long, shingles array<bigint>", start)


def _search(docs: DataFrame, rows: DataFrame, pairs: DataFrame, k: int, num: int, den: int, block: int, max_broadcast: int, work: Workspace) -> DataFrame:
    first = rows.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("one"), F.max("n_shingles").alias("n"))
    who = work.table(components(pairs).join(first, F.col("node") == F.col("digest")).select("one.doc_id", "one.h", "digest", "label", "n"), "ngram-members")
    who = who.join(who.groupBy("label").agg(F.sum("n").alias("weight")), "label")
    # what is too heavy for a block is cut by size: only sets of one band or of two neighbouring ones can link
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + F.lit(1e-9)).cast("int")
    heavy = who.where(F.col("weight") > block).withColumn("own", band).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") - 1))).drop("weight")
    groups = heavy.groupBy("label", "band").agg(F.min("digest").alias("least"), F.sum("n").alias("weight"), F.max(F.col("own") == F.col("band")).alias("any_own"), F.count("*").alias("members")).where("any_own and members > 1")
    heavy = heavy.join(groups, ["label", "band"]).select("doc_id", "h", "digest", F.concat("least", F.col("label"), F.col("band").cast("string").cast("binary")).alias("label"), "n", "weight")
    heavy = work.table(heavy, "ngram-heavy")
    ready = who.where(F.col("weight") <= block).select("doc_id", "h", "digest", "label", "weight").union(heavy.where(F.col("weight") <= block).select("doc_id", "h", "digest", "label", "weight"))
    found = _run_blocks(_sets_of(docs, ready, k, max_broadcast).select(F.col("label").alias("key"), F.lit(0).alias("role"), "digest", "shingles"), num, den)
    large = heavy.where(F.col("weight") > block)
    if large.limit(1).count():
        found = found.union(_large(_sets_of(docs, large, k, max_broadcast), num, den, block, work))
    return work.table(found, "ngram-links")


class _Union:
    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.up[b] = a
        self.size[a] += self.size[b]
        return True


def forest(links: DataFrame) -> DataFrame:
    """Fewer links that connect the same: each task keeps a spanning forest of those it reads, some hundred thousand nodes at a time."""
    out = to_arrow_schema(struct_of("a binary, b binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        union = _Union(0)
        for batch in batches:
            if len(index) > 200_000:
                index, union = {}, _Union(0)
            kept = []
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                ends = []
                for x in (a, b):
                    if x not in index:
                        index[x] = len(index)
                        union.up.append(len(union.up))
                        union.size.append(1)
                    ends.append(index[x])
                if union.join(*ends):
                    kept.append((a, b))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*kept, strict=True)], schema=out)

    return links.mapInArrow(tidy(run), "a binary, b binary")


def _large(members: DataFrame, num: int, den: int, block: int, work: Workspace) -> DataFrame:
    """Components of more than one block: the least class against all, then those that don't link with it against every block."""
    pivots = members.where("digest = substring(label, 1, 16)").dropDuplicates(["label"]).select("label", F.col("shingles").alias("pivot"))
    pivots, _ = broadcast_if_small(pivots, 1000)

    def start():
        def apply(cols):
            return {"digest": cols["digest"], "label": cols["label"], "weight": cols["weight"], "shingles": cols["shingles"], "core": [d == e[:16] or linked(np.array(s, np.int64), np.array(p, np.int64), num, den) for d, e, s, p in zip(cols["digest"], cols["label"], cols["shingles"], cols["pivot"], strict=True)]}

        return apply

    schema = "digest binary, label binary, weight long, shingles array<bigint>, core boolean"
    judged = work.table(map_columns(members.join(pivots, "label").select("digest", "label", "weight", "shingles", "pivot"), schema, start), "ngram-judged")
    star = judged.where("core and digest <> substring(label, 1, 16)").select(F.expr("substring(label, 1, 16)").alias("a"), F.col("digest").alias("b"))
    rest = judged.where("not core").groupBy("label").agg(F.sum(F.size("shingles")).alias("rest"))
    n_all, n_rest = F.ceil(F.col("weight") / block).cast("int"), F.ceil(F.col("rest") / block).cast("int")
    cut = judged.join(F.broadcast(rest) if rest.limit(10_001).count() <= 10_000 else rest, "label").withColumn("of_all", F.pmod(F.xxhash64("digest"), n_all)).withColumn("of_rest", F.pmod(F.xxhash64("digest"), n_rest))
    key = lambda i, j: F.concat(F.col("label"), F.concat_ws(".", i, j).cast("binary"))
    asking = cut.where("not core").select("*", F.explode(F.sequence(F.lit(0), n_all - 1)).alias("j")).select(key(F.col("of_rest"), F.col("j")).alias("key"), F.lit(1).alias("role"), "digest", "shingles")
    asked = cut.select("*", F.explode(F.sequence(F.lit(0), n_rest - 1)).alias("i")).select(key(F.col("i"), F.col("of_all")).alias("key"), F.lit(2).alias("role"), "digest", "shingles")
    return star.union(_run_blocks(asking.union(asked), num, den))


def _run_blocks(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) found in each block: rows of one key. Role 0 asks and is asked, 1 asks, 2 is asked."""
    out = to_arrow_schema(struct_of("a binary, b binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, sets, asks = None, [], [], []

        def done() -> pa.RecordBatch:
            index = {}
            for k, (d, q) in enumerate(zip(names, asks, strict=True)):
                if d not in index or q and not asks[index[d]]:
                    index[d] = k
            use = sorted(index.values())
            found = block_links([sets[k] for k in use], [asks[k] for k in use], num, den)
            return pa.RecordBatch.from_arrays([pa.array([names[use[i]] for i, _ in found], pa.binary()), pa.array([names[use[j]] for _, j in found], pa.binary())], schema=out)

        for batch in (p for b in batches for p in pieces(b)):
            flat, offset = batch["shingles"].flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(batch["shingles"].value_lengths().to_numpy())])
            for k, (key, role, name) in enumerate(zip(batch["key"].to_pylist(), batch["role"].to_pylist(), batch["digest"].to_pylist(), strict=True)):
                if key != at and names:
                    yield done()
                    names, sets, asks = [], [], []
                at = key
                names.append(name)
                sets.append(flat[offset[k] : offset[k + 1]].copy())
                asks.append(role != 2)
        if names:
            yield done()

    return members.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "a binary, b binary")


def _labels(rows: DataFrame, links: DataFrame, least: Column) -> DataFrame:
    """(digest, least, label) of each class of texts with words: the least of its rows, and the least class that links reach."""
    first = rows.where("n_shingles > 0").groupBy("digest").agg(F.min(least).alias("least"))
    return materialise(rows.sparkSession, first.join(components(links), F.col("digest") == F.col("node"), "left").select("digest", "least", F.coalesce("label", "digest").alias("label")), "ngram-labels")


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, **more) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    rows, links = classes_and_links(docs, k, num, den, **more)
    named = _labels(rows, links, F.col("doc_id"))
    root = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = named.join(root, "label").select(F.col("digest").alias("own"), "component_id")
    return rows.join(classes, (F.col("digest") == F.col("own")) & (F.col("n_shingles") > 0), "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, **more) -> DataFrame:
    """One row of each group of near copies, all columns as they are: that of the least doc_id (null after all others), then of the least hash of
    its text, then of the least row number. A text without words resembles nothing, so its rows all stay. Row numbers are fixed in a written table."""
    number = "_row"
    while number.lower() in map(str.lower, docs.columns):
        number += "_"
    numbered = materialise(docs.sparkSession, docs.withColumn(number, F.monotonically_increasing_id()), "ngram-numbered")
    work = Workspace(docs.sparkSession)
    rows, links = classes_and_links(numbered, k, num, den, row_col=number, work=work, **more)
    named = _labels(rows, links, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "row"))
    stay = named.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.row").alias(number)).union(rows.where("n_shingles = 0").select("row"))
    stay = materialise(docs.sparkSession, stay, "ngram-stay")
    work.drop()
    return numbered.join(stay, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
