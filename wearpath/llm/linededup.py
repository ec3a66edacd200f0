"""Line deduplication: MinHash bands, exact Jaccard verification, and one line kept of each component."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearpath.llm.common import chunks, map_batches, stored
from wearpath.llm.graph import CHUNK, link_buckets, shared_buckets

#: Characters of a shingle, least Jaccard similarity, bands and rows of a band. A pair at
#: 0.8 shares a band with probability 0.997, one at 0.9 with 0.99998.
SHINGLE, THRESHOLD, BANDS, ROWS = 8, 0.8, 8, 3
#: Least and most bits of the filter for the lines whose texts are needed, and bits for each line between: 4 MB to 64 MB.
FILTER_BITS, MOST_FILTER_BITS, LINE_BITS = 1 << 25, 1 << 29, 8
#: Lines whose signatures are computed at once; their hashes stay in a processor's cache.
SLICE = 500
#: Parts that band keys are dealt out to, rows that a task packs at once, and most rows of a part that are sorted at once.
PARTS, PACKED, MOST = 4096, 1 << 20, 1 << 21
#: Lines of one bucket that a task compares with as many others at once.
BLOCK = 256
#: Largest group that is gathered with others and compared by sketches first; at most about its square of pairs at once.
SMALL = 128
#: Bits of the sketch that rules out pairs before their shingles are compared, and pairs looked at by sketch at once.
SKETCH, PAIRS = 2048, 4096
#: Largest number of possible shingles that are numbered by a table.
TABLE = 1 << 19

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _multipliers(n: int) -> np.ndarray:
    """Odd 32-bit multipliers, one for each hash function."""
    return np.random.default_rng(42).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _normal(line: str) -> str:
    """What lines are compared by: lower case, runs of white space as one blank."""
    low = line.lower().strip()
    return low if low.isprintable() and "  " not in low else " ".join(low.split())


def shingles(line: str, k: int = SHINGLE) -> set[str]:
    """The character shingles of a line; a line shorter than ``k`` is its own."""
    text = _normal(line)
    return {text[i : i + k] for i in range(max(1, len(text) - k + 1))}


def _shingle_hashes(normal: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all windows of ``k`` characters, and how many of them are each line's shingles, repeats included.

    The windows run on over the lines' ends: between the shingles of two lines stand ``k`` - 1 that belong to neither.
    """
    padded = [t if len(t) >= k else t.ljust(k, "\0") for t in normal]
    sizes = np.array([len(t) for t in padded])
    h = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    spare = np.empty_like(h)  # the arrays are used again, as fresh memory costs more than the arithmetic
    with np.errstate(over="ignore"):
        width, power = 1, _MUL
        while width < k:  # doubling: a window of 2w is two of w; k is a power of two
            np.multiply(h[width:], power, out=spare[:-width])
            h, spare = h[:-width], spare[:-width]
            h += spare
            width, power = 2 * width, power * power
        h ^= np.right_shift(h, np.uint64(32), out=spare)
        h *= _MIX
    h ^= np.right_shift(h, np.uint64(29), out=spare)
    return h, sizes - k + 1


def band_keys(lines: list[str], k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(lines, bands) keys; equal shingle sets have equal keys."""
    parts = [_band_keys(lines[i : i + SLICE], k, bands, rows) for i in range(0, len(lines), SLICE)]
    return np.concatenate(parts) if parts else np.zeros((0, bands), np.int64)


def _band_keys(lines: list[str], k: int, bands: int, rows: int) -> np.ndarray:
    h, counts = _shingle_hashes(list(map(_normal, lines)), k)
    h32 = (h >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(counts + k - 1) - counts - k + 1
    bounds = np.stack([starts, starts + counts], axis=1).ravel()[:-1]  # every second stretch is between two lines
    factors = _multipliers(bands * rows)
    keys, product = np.empty((len(lines), bands), np.uint64), np.empty_like(h32)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(lines), b + 1, np.uint64)
            for r in range(rows):
                low = np.minimum.reduceat(np.multiply(h32, factors[b * rows + r], out=product), bounds)[::2]
                key = (key ^ low) * _MUL
                key ^= key >> np.uint64(29)
            keys[:, b] = key
    return keys.view(np.int64)


def _sketches(normal: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """For each line a row of ``SKETCH`` bits, those of its shingles' hashes set, and how many shingles it has, repeats included."""
    bits, sizes, flags = [], [], np.zeros((SLICE + 1, SKETCH), bool)  # the last row is for what is between two lines
    for i in range(0, len(normal), SLICE):
        h, counts = _shingle_hashes(normal[i : i + SLICE], k)
        n = len(counts)
        rows = np.stack([np.arange(n), np.full(n, SLICE)], axis=1).ravel() * SKETCH
        place = (h & np.uint64(SKETCH - 1)).view(np.int64)
        place += np.repeat(rows, np.stack([counts, np.full(n, k - 1)], axis=1).ravel())[: len(h)]
        flags.ravel()[place] = True
        bits.append(np.packbits(flags[:n], axis=1).view(np.uint64))
        sizes.append(counts)
        flags.ravel()[place] = False
    return np.concatenate(bits), np.concatenate(sizes)


def _may_be_alike(normal: list[str], x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (normal[x], normal[y]) the lines' sketches do not rule out; every similar pair is among them.

    A bit that only one line has stands for at least one shingle that the other line lacks.
    So the shingles that only one has are at least these bits, and the common ones at most a line's shingles less its own bits.
    """
    bits, sizes = _sketches(normal)
    own = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    out = np.empty(len(x), bool)
    for i in range(0, len(x), PAIRS):
        p, q = x[i : i + PAIRS], y[i : i + PAIRS]
        both = np.bitwise_count(bits[p] & bits[q]).sum(axis=1, dtype=np.int64)
        lone_p, lone_q = own[p] - both, own[q] - both
        common = np.minimum(sizes[p] - lone_p, sizes[q] - lone_q)
        out[i : i + PAIRS] = common + 0.01 >= threshold * (common + lone_p + lone_q)  # well above what rounding may lose
    return out


def _shingle_codes(normal: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the shingles of all lines, equal only for equal shingles, line after line and repeats included; and how many each line has."""
    sizes = np.array([max(len(t), k) for t in normal])
    code = np.frombuffer("".join(t if len(t) >= k else t.ljust(k) for t in normal).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.zeros(int(code.max()) + 1, bool)
    known[code] = True
    code = np.cumsum(known, dtype=np.uint64)[code]  # from 1, as 0 fills up short lines
    ends = np.cumsum(sizes)
    for i in np.nonzero(sizes == k)[0]:
        code[ends[i] - k + len(normal[i]) : ends[i]] = 0
    base, width = int(code.max()) + 1, 1
    if k == 8 and base <= 256:  # a shingle's eight bytes are its number
        code, width = np.ndarray(len(code) - 7, np.uint64, code.astype(np.uint8), strides=(1,)).copy(), k
    while width < k:  # doubling: a shingle of 2w is two of w; k is a power of two
        if width > 1 and base <= TABLE:  # numbered anew by a table, which needs no sorting
            known = np.zeros(base, bool)
            known[code] = True
            code = (np.cumsum(known, dtype=np.uint64) - np.uint64(1))[code]
            base = int(code.max()) + 1
        if base > 1 << 32:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            base = int(code.max()) + 1
        code = code[:-width] * np.uint64(base) + code[width:]
        base, width = base * base, 2 * width
    valid = np.ones(ends[-1], bool)
    for back in range(1, k):
        valid[ends - back] = False
    return code[valid[: len(code)]], sizes - k + 1


def _shingle_sets(normal: list[str]) -> list[np.ndarray]:
    """For each line the sorted numbers of its different shingles; they hold for this call only."""
    code, counts = _shingle_codes(normal)
    base = int(code.max()) + 1
    if base * len(normal) < 1 << 64:  # all lines in one sort
        at = np.repeat(np.arange(len(normal), dtype=np.uint64) * np.uint64(base), counts)
        code += at
        code.sort()
        code -= at
    else:
        at = np.cumsum(counts).tolist()
        for i, j in zip([0, *at], at):
            code[i:j].sort()
    new = np.ones(len(code), bool)
    np.not_equal(code[1:], code[:-1], out=new[1:])
    starts = np.cumsum(counts) - counts
    new[starts] = True
    kept = code[new]
    ends = np.cumsum(np.add.reduceat(new, starts, dtype=np.int64)).tolist()
    return [kept[i:j] for i, j in zip([0, *ends], ends)]


def alike_pairs(lines: list[str], x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs (lines[x], lines[y]) have shingle sets of at least the given Jaccard similarity."""
    out = np.zeros(len(x), bool)
    if not len(x):
        return out
    normal = list(map(_normal, lines))
    left = np.nonzero(_may_be_alike(normal, x, y, threshold))[0]
    used, at = np.unique(np.concatenate((x[left], y[left])), return_inverse=True)
    sets = _shingle_sets([normal[i] for i in used.tolist()]) if len(used) else []
    sizes = np.array([len(one) for one in sets], int)
    x, y = at[: len(left)], at[len(left) :]
    least, most = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
    for p in np.nonzero(least >= threshold * most)[0].tolist():
        both = np.concatenate((sets[x[p]], sets[y[p]]))
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        out[left[p]] = common >= threshold * (sizes[x[p]] + sizes[y[p]] - common)
    return out


def alike(a: str, b: str, threshold: float = THRESHOLD) -> bool:
    """Whether the shingle sets of two lines have at least the given Jaccard similarity."""
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both >= threshold * (len(x) + len(y) - both)


def occurrences(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, th, pos, lid, keys): every line with a visible character, by document and position.

    ``th`` is a hash of the text; ``lid`` the line's 128-bit hash; ``keys`` its band keys, or
    null where the same batch already had the line.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                at, pos, lids, first, seen = [], [], [], [], {}
                for i, t in enumerate(part.column("text")):
                    text = t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else ""
                    for p, line in enumerate(text.split("\n")):
                        if line.strip():
                            lid = xxhash.xxh3_128_digest(line.encode("utf-8"))
                            if lid not in seen:
                                seen[lid] = line
                                first.append(len(at))
                            at.append(i)
                            pos.append(p)
                            lids.append(lid)
                keys = band_keys(list(seen.values()))
                new = np.zeros(len(at), bool)
                new[first] = True
                offsets = pa.array(np.concatenate([[0], np.cumsum(new)]) * BANDS, pa.int32(), mask=np.append(~new, False))
                take = pa.array(at, pa.int64())
                yield pa.record_batch(
                    [part.column("id").take(take), part.column("th").take(take), pa.array(pos, pa.int32()), pa.array(lids, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                    names=["id", "th", "pos", "lid", "keys"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), F.col(text_column).cast("binary").alias("text"))
    return map_batches(rows, work, f"id {kind}, th bigint, pos int, lid binary, keys array<bigint>")


def filter_bits(lines: int) -> int:
    """A power of two of at least ``LINE_BITS`` bits a line, within the bounds."""
    return min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (LINE_BITS * lines).bit_length()))


def _line_filter(wanted: DataFrame) -> np.ndarray:
    """A bitmap of the first 32 bits of ``wanted`` (lid), sized by their number up to 64 MB.

    It lets an eighth of the other lines pass, more beyond 67 million wanted ones, and never
    stops a wanted line; what passes needlessly ends in the join with ``wanted``.
    """
    size = filter_bits(wanted.count())
    place = F.pmod(F.conv(F.hex(F.substring("lid", 1, 4)), 16, 10).cast("bigint"), F.lit(size))
    part = 4096 * 8
    rows = (
        wanted.select(place.alias("p"))
        .groupBy(F.floor(F.col("p") / part).alias("k"))
        .agg(F.bitmap_construct_agg(F.pmod("p", F.lit(part))).alias("bits"))
        .collect()
    )
    bits = np.zeros(size // 8, np.uint8)
    for k, found in rows:
        bits[k * 4096 : k * 4096 + len(found)] = np.frombuffer(bytes(found), np.uint8)
    return bits


def line_texts(docs: DataFrame, wanted: DataFrame, text_column: str) -> DataFrame:
    """(lid, line) of the lines in ``wanted`` (lid); each once."""
    shared = docs.sparkSession.sparkContext.broadcast(_line_filter(wanted).tobytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        size = 8 * len(bits)
        for batch in batches:
            seen = {}
            for t in batch.column("text"):
                text = t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else ""
                for line in text.split("\n"):
                    lid = xxhash.xxh3_128_digest(line.encode("utf-8"))
                    p = int.from_bytes(lid[:4]) % size
                    if bits[p >> 3] >> (p & 7) & 1:
                        seen[lid] = line
            yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.string())], names=["lid", "line"])

    lines = map_batches(docs.select(F.col(text_column).cast("binary").alias("text")), work, "lid binary, line string")
    return lines.join(wanted, "lid", "left_semi").dropDuplicates(["lid"])


def similar(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose lines' shingle sets have at least the given Jaccard similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "x"):
                at: dict[str, int] = {}  # a line is often in many pairs
                x, y = (np.array([at.setdefault(line, len(at)) for line in b.column(c).to_pylist()], int) for c in "xy")
                yield b.select(["a", "b"]).filter(pa.array(alike_pairs(list(at), x, y, threshold), pa.bool_()))

    met = (
        pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a")
        .join(texts.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return map_batches(met, work, "a binary, b binary")


class _Groups:
    """Union-find over component ids within a task's group."""

    def __init__(self) -> None:
        self.up: dict[bytes, bytes] = {}

    def root(self, c: bytes) -> bytes:
        up = self.up
        while (above := up.get(c, c)) != c:
            up[c] = up.get(above, above)
            c = above
        return c

    def join(self, a: bytes, b: bytes) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _crowded_links(lines: list[str], comps: list[bytes], first: int, threshold: float) -> Iterator[tuple[int, int]]:
    """Links (i, j) that join the components of similar lines, i before row ``first`` and j from it on; all i < j if it is 0.

    Shingle sets become bit sets over the shingles that two lines have at least.
    """
    sets = _shingle_sets(list(map(_normal, lines)))
    sizes = [len(one) for one in sets]
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[number]
    shared, groups, bits, at = int((times > 1).sum()), _Groups(), [], 0
    for n in sizes:
        flags = np.zeros(shared, np.uint8)
        found = place[at : at + n]
        flags[found[found >= 0]] = 1
        bits.append(int.from_bytes(np.packbits(flags)))
        at += n
    for i in range(first or len(lines)):
        bi, ni, ci = bits[i], sizes[i], comps[i]
        for j in range(first or i + 1, len(lines)):
            if ci != comps[j]:
                both = (bi & bits[j]).bit_count()
                if both >= threshold * (ni + sizes[j] - both) and groups.join(ci, comps[j]):
                    yield i, j


def compare_blocks(rows: DataFrame, bucket: list[str], texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) that join the different ``c`` of each bucket in ``rows`` (bucket..., id, c, size).

    A bucket is cut into blocks of about ``BLOCK`` rows, and each pair of blocks is one
    group, so a group is bounded however large the bucket is. Groups stream through a task
    one after the other; small ones are gathered and compared together.
    """
    own = (
        rows.join(texts.withColumnRenamed("lid", "id"), "id")
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    )
    group = F.struct(*bucket, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = (
        own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(F.to_json(group).alias("g"), "own", "id", "c", "line")
        .repartition("g")
        .sortWithinPartitions("g", "own", "id")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: list[list[tuple]] = []
        pairs = 0

        def links(group: list[tuple]) -> list[tuple[bytes, bytes]]:
            first = next((k for k, r in enumerate(group) if r[1] == group[-1][1]), 0)
            found = _crowded_links([r[4] for r in group], [r[3] for r in group], first, threshold)
            return [(group[i][2], group[j][2]) for i, j in found]

        def gathered() -> list[tuple[bytes, bytes]]:
            number: dict[str, int] = {}  # a line is often in several groups
            comps: dict[bytes, int] = {}
            ids = [r[2] for group in small for r in group]
            line = np.array([number.setdefault(r[4], len(number)) for group in small for r in group], int)
            comp = np.array([comps.setdefault(r[3], len(comps)) for group in small for r in group], int)
            x, y, start = [np.zeros(0, int)], [np.zeros(0, int)], 0
            for group in small:
                j, i = triangle(len(group))
                x.append(i + start)
                y.append(j + start)
                start += len(group)
            small.clear()
            a, b = np.concatenate(x), np.concatenate(y)
            open_ = comp[a] != comp[b]
            a, b = a[open_], b[open_]
            near = alike_pairs(list(number), line[a], line[b], threshold)
            return [(ids[i], ids[j]) for i, j in zip(a[near].tolist(), b[near].tolist())]

        def packed(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            a, b = zip(*found) if found else ((), ())
            return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        def closed(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal pairs
            if len(group) > SMALL:
                yield packed(links(group))
            elif group:
                small.append(group)
                pairs += len(group) * (len(group) - 1) // 2
                if len(small) >= 500 or pairs >= SMALL * SMALL:
                    pairs = 0
                    yield packed(gathered())

        triangle = cache(lambda n: np.tril_indices(n, -1))
        group: list[tuple] = []
        for b in batches:
            for r in zip(*(column.to_pylist() for column in b.columns)):  # g, own, id, c, line
                if group and r[0] != group[0][0]:
                    yield from closed(group)
                    group = []
                group.append(r)
        yield from closed(group)
        yield packed(gathered())

    return map_batches(met, work, "a binary, b binary")


def repeated_keys(keys: DataFrame) -> DataFrame:
    """Rows (id, key) of ``keys`` (id, key), ids of 16 bytes and ``key`` a number or an array of them, without those whose key has no other id.

    Most keys occur once, or with copies of one line. A task deals its rows out to ``PARTS`` parts by key and
    packs those of a part into one row, so few rows are shuffled. The rows of a part, or of several small ones, are
    sorted together and lose repeats and the keys with one id. A part with more than ``MOST`` rows, as a hot
    key makes it, goes on in pieces of that size that keep all keys; the window after this finds the lone ones.
    """
    if keys.schema["key"].dataType.typeName() != "array":
        keys = keys.withColumn("key", F.array("key"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            key, ids = (np.concatenate(c) for c in zip(*found))
            part = (key % np.uint64(PARTS)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            key, ids = key[order].tobytes(), ids[order].tobytes()
            counts = np.bincount(part, minlength=PARTS)
            parts = np.nonzero(counts)[0]
            at = np.concatenate([[0], np.cumsum(counts[parts])])
            packs = [pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer((at * n).astype(np.int32)), pa.py_buffer(c)]) for n, c in ((8, key), (16, ids))]
            yield pa.record_batch([pa.array(parts, pa.int32()), *packs], names=["part", "keys", "ids"])

        for batch in batches:
            lists = batch.column("key")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = np.frombuffer(b"".join(batch.column("id").to_pylist()), np.uint64).reshape(-1, 2)
            found.append((lists.flatten().to_numpy().view(np.uint64), np.repeat(ids, sizes, axis=0)))
            rows += int(sizes.sum())
            if rows >= PACKED:
                yield from packed()
                found, rows = [], 0
        yield from packed()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rows, part, cut = 0, None, False

        def repeated(every: bool) -> Iterator[pa.RecordBatch]:
            key, ids = (np.concatenate(c) for c in zip(*found))
            if not every:
                order = np.argsort(key)
                ordered = key[order]
                same = np.zeros(len(key) + 1, bool)
                np.equal(ordered[1:], ordered[:-1], out=same[1:-1])
                left = order[same[:-1] | same[1:]]
                key, ids = key[left], ids[left]
            order = np.lexsort((ids[:, 1], ids[:, 0], key))
            key, ids = key[order], ids[order]
            other = np.ones(len(key) + 1, bool)  # another key than the row before
            np.not_equal(key[1:], key[:-1], out=other[1:-1])
            new = other[:-1].copy()
            new[1:] |= (ids[1:] != ids[:-1]).any(axis=1)
            key, ids, first = key[new], ids[new], other[:-1][new]
            if not every:
                shared = ~(first & np.append(first[1:], True)[: len(key)])
                key, ids = key[shared], ids[shared]
            places = pa.py_buffer(np.arange(0, 16 * len(key) + 1, 16, dtype=np.int32))
            out = pa.Array.from_buffers(pa.binary(), len(key), [None, places, pa.py_buffer(ids.tobytes())])
            yield pa.record_batch([out, pa.array(key.view(np.int64))], names=["id", "key"])

        for batch in batches:
            for p, key, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if p != part:
                    if rows >= CHUNK or cut:
                        if rows:
                            yield from repeated(cut)
                        found, rows = [], 0
                    part, cut = p, False
                elif rows >= MOST:
                    yield from repeated(True)
                    found, rows, cut = [], 0, True
                found.append((np.frombuffer(key, np.uint64), np.frombuffer(ids, np.uint64).reshape(-1, 2)))
                rows += len(key) // 8
        if rows:
            yield from repeated(cut)

    parts = map_batches(keys.select("id", "key"), dealt, "part int, keys binary, ids binary", rows=CHUNK)
    return map_batches(parts.repartition("part").sortWithinPartitions("part"), work, "id binary, key bigint")


def line_components(docs: DataFrame, found: DataFrame, text_column: str) -> DataFrame:
    """(id, component) of the different lines that have a near copy; ids are line hashes."""
    keys = found.where("keys is not null").select(F.col("lid").alias("id"), F.col("keys").alias("key"))
    members = stored(shared_buckets(repeated_keys(keys), ["key"]), "line_buckets")
    wanted = stored(members.select(F.explode(F.array("id", "leader")).alias("lid")).distinct(), "line_ids")
    texts = stored(line_texts(docs, wanted, text_column), "line_texts")
    return link_buckets(members, ["key"], lambda pairs: similar(pairs, texts), lambda rows, bucket: compare_blocks(rows, bucket, texts))


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, th, dropped): each document with repeated lines and their positions from 0, in order.

    Lines are alike if they are equal or their character shingles have a Jaccard similarity
    of at least 0.8; alike lines, and what can be reached from them, are one component. Its
    first line by (id, text hash, position) stays, all others are dropped. Lines without a
    visible character are never dropped. Null ids come first and are documents like others,
    told apart by their text; null and empty texts have no lines, and an empty table gives no rows.
    """
    found = stored(occurrences(docs, id_column, text_column), "lines")
    joined = line_components(docs, found, text_column).withColumnRenamed("id", "lid")
    place = F.struct("id", "th", "pos")
    once = found.groupBy("lid").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    marked = stored(once.join(joined, "lid", "left").where("component is not null or n > 1"), "repeated")
    lone = F.col("component").isNull()
    per = marked.where(~lone).groupBy("component").agg(F.min("first").alias("keep"))
    kept = marked.where(~lone).join(per, "component").select("lid", "keep").unionByName(marked.where(lone).select("lid", F.col("first").alias("keep")))
    return (
        found.select("id", "th", "pos", "lid")
        .join(kept.hint("shuffle_hash"), "lid")
        .where(~F.col("keep").eqNullSafe(place))
        .groupBy("id", "th")
        .agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    )


def without_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with repeated lines removed from the texts; columns and rows stay.

    A document whose lines all go has an empty text, a null text stays null. Rows with the
    same id and text count as one document, also with a null id. ``n_chars``, where it exists,
    follows the text. An empty table gives no rows.
    """
    names = docs.columns
    at, last = names.index(text_column), len(names)
    plain = docs.toDF(*(f"c{i}" for i in range(last)))  # no name can clash
    key, text = F.col(f"c{names.index(id_column)}"), F.col(f"c{at}")
    gone = repeated_lines(docs, id_column, text_column).hint("shuffle_hash")
    met = plain.join(gone, key.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("th")), "left").drop("id", "th")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, dropped in zip(b.column(at), b.column(last)):
                if not text.is_valid or not dropped.is_valid:
                    out.append(text.as_py())
                else:
                    away = set(dropped.as_py())
                    out.append("\n".join(line for p, line in enumerate(text.as_py().split("\n")) if p not in away))
            columns = list(b.columns)[:last]
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = map_batches(met, work, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_column).cast(docs.schema["n_chars"].dataType))
    return out
