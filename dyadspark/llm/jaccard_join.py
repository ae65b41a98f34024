"""Documents whose word shingles overlap: candidates by equal parts of shingle sets, overlaps by T-occurrence search.

Two sets with Jaccard similarity of num/den or more, of S shingles together, differ in (den - num) / (den + num) * S at most.
Cut both by hash into more parts than that and some parts are equal. Sizes fall into ranges, a range has one number of parts,
and a set is cut for each range that may hold a partner. There are `spare` parts more than needed, so that parts without
shingles needn't count; a set with more of those than that is also known by each spare + 1 of them.

Sets with an equal part form a bucket. Each is hung on the bucket's least, slice by slice and then in all, so buckets of any
size give stars and not pairs. Then the set that is in most buckets becomes a bucket's hub: among near copies of one text, the
one closest to the others. Hubs are searched first: each is a query to the index of the others in its buckets. Most buckets
are then connected; only those that aren't are searched all against all, in blocks, across components. Before any search, sketches rule out what can't be: one bit for each hash value, flipped by each shingle, so that two sketches
differ in no more bits than their sets in shingles. Only texts of sets that pass are fetched.

That gives components. Every link is within one, so links are counted by searching each component of three texts or more all
against all, each pair of texts in one task: again T-occurrence, for many queries at once by counting all lists.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.common import bucketed, numbered, text_key, written
from dyadspark.llm.components import components
from dyadspark.llm.textvec import SLICE, U, Rolling, Words, in_parts, mix, packed, slices, unpacked, windows_within

WORDS, SIMILAR = 5, (80, 100)
SPARE, RATIO, BLOCK = 2, 1.5, 256
#: Blocks that sketches are compared across in one task.
SKETCHED = 8
#: Differences up to which a range has just SPARE spare parts.
FEW = 9
#: Texts of a component that travel as one row, and postings that are counted at once.
PACK, POSTINGS = 64, 4_000_000
#: Characters of text that a part of the signatures stands for, the least number of parts (a power of two), and signatures that
#: a task gathers before it sends each part its own.
PART_CHARS, PARTS, GATHERED = 16_000_000, 64, 600_000


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """row, hash of each row's different shingles, by row; a text with fewer words has its whole sequence as one."""
    x = Words(raw, offsets, lower=True)
    roll = Rolling(x.h[0])
    n = np.diff(x.first)
    short = np.flatnonzero((n > 0) & (n < size))
    at = windows_within(x.first, size)
    row = np.concatenate([np.searchsorted(x.first, at, "right") - 1, short])
    h = np.concatenate([roll.windows(at, size), roll.windows(x.first[short], n[short])])
    with np.errstate(over="ignore"):
        _, one = np.unique(h + mix(row.astype(U)), return_index=True)
    order = one[np.argsort(row[one], kind="stable")]
    return row[order], h[order]


class Ranges:
    """Ranges of set sizes: range j is for pairs whose smaller set has low[j] to low[j + 1] - 1 shingles."""

    def __init__(self, similar: tuple[int, int]):
        self.num, self.den = similar
        if not 7 * self.den <= 10 * self.num <= 10 * self.den:
            raise ValueError("parts of sets tell candidates for similarities from 0.7 to 1")
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(low[-1] * RATIO)))
        self.low = np.array(low)
        self.top = (self.low[1:] - 1) * self.den // self.num  # of the larger set
        self.apart = (self.low[1:] - 1 + self.top) * (self.den - self.num) // (self.den + self.num)
        spare = np.full(len(self.apart), SPARE)
        for _ in range(20):  # large sets: so many that more empty parts are rare in the range's smallest sets
            q = self.apart + 1.0 + spare
            empty = q * np.exp(-self.low[:-1] / q)
            spare = np.where(self.apart > FEW, np.minimum(np.maximum(SPARE, np.ceil(empty + 4 * np.sqrt(empty)) + 1), self.apart), SPARE).astype(np.int64)
        self.spare = np.where(self.apart > 0, spare, 0)
        self.parts = self.apart + 1 + self.spare

    def of(self, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sets, range): of their sizes n, each set with each range it belongs to."""
        own = np.searchsorted(self.low, n, "right") - 1
        for back in range(3):
            j = own - back
            some = np.flatnonzero((j >= 0) & (n <= self.top[np.maximum(j, 0)]))
            if len(some):
                yield some, j[some]


def signatures(row: np.ndarray, h: np.ndarray, n_rows: int, ranges: Ranges) -> tuple[np.ndarray, np.ndarray]:
    """row, signature: buckets of each set."""
    first = np.searchsorted(row, np.arange(n_rows + 1))
    size = np.diff(first)
    rows, sigs = [], []
    again = mix(h + U(7))
    for sets, j in ranges.of(size):
        length, q = size[sets], ranges.parts[j]
        at = np.repeat(first[sets] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        which = np.repeat(np.arange(len(sets)), length)
        base = np.cumsum(q) - q
        cell = base[which] + ((h[at] >> U(20)) % q[which].astype(U)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(again[at][order], begin)
            cell = cell[begin]
            own = np.searchsorted(base, cell, "right") - 1
            name = (j[own] * 65_537).astype(U) * U(1 << 20) + (cell - base[own]).astype(U)
            sigs.append(mix(total + mix(name)))
        rows.append(sets[own])
        empty = q - np.bincount(own, minlength=len(sets))
        crowded = (empty > ranges.spare[j]) & (ranges.apart[j] > 0)
        # many parts without shingles: in ranges of many parts that is rare, and such sets form one bucket a range
        few = np.flatnonzero(crowded & (ranges.apart[j] > FEW))
        sigs.append(mix(mix((j[few] + 1).astype(U) << U(50)) ^ U(0xE4)))
        rows.append(sets[few])
        for k in np.flatnonzero(crowded & (ranges.apart[j] <= FEW)):  # else each combination of spare + 1 of them, 220 at most
            none = sorted(set(range(int(q[k]))) - set((cell[own == k] - base[k]).tolist()))
            codes = [hash(c) & (1 << 64) - 1 for c in combinations(none, int(ranges.spare[j[k]]) + 1)]  # of ints: the same everywhere
            with np.errstate(over="ignore"):
                sigs.append(mix(np.array(codes, U) ^ mix(np.array([int(j[k]) + 1], U) << U(50))))
            rows.append(np.full(len(codes), sets[k]))
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(sigs) if sigs else np.zeros(0, U)


def sketch(h: np.ndarray, per: int = 2) -> bytes:
    """A bit for each value of the hash, flipped by each shingle: `per` bits a shingle at least, a power of two, 256 or more."""
    bits = max(256, 1 << int(per * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h >> U(3)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of one length, the least: halves of longer ones laid on each other."""
    least = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, least // 8), 0) for s in sketches])


def _stars(texts: DataFrame, size: int, similar: tuple[int, int], bits: int) -> DataFrame:
    """sig, a, b long: in each bucket every id but the least is hung on a smaller one."""

    kinds = {"part": pa.int32(), "n": pa.int32(), "sigs": pa.binary(), "local": pa.binary(), "ids": pa.binary(), "e_sig": pa.binary(), "e_a": pa.binary(), "e_b": pa.binary()}

    def dealt(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """For each part its signatures, each with the least id, and the edges of ids that have a signature too."""
        sig, node = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        head = np.flatnonzero(new)
        lead = np.repeat(head, np.diff(np.append(head, len(sig))))
        edge = np.flatnonzero((node != node[lead]) & ~new)
        lone, least = sig[head], node[head]
        sides = in_parts(sig[edge], bits)
        rows = []
        for part, (i, k) in in_parts(lone, bits).items():
            used, local = np.unique(least[i:k], return_inverse=True)
            own = edge[slice(*sides.get(part, (0, 0)))]
            rows.append((part, k - i, packed(np.diff(lone[i:k], prepend=U(0))), packed(local.astype(np.uint16) if len(used) < 65536 else local.astype(np.uint32)), used.tobytes(), sig[own].tobytes(), node[lead[own]].tobytes(), node[own].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds.values(), strict=True)], list(kinds))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, held, n = Ranges(similar), [], 0
        for batch in batches:
            for a, b, raw, offsets in slices(batch.column(1), SLICE):
                row, sig = signatures(*shingles(raw, offsets, size), b - a, ranges)
                held.append((sig, batch.column(0).slice(a, b - a).to_numpy()[row]))
                n += len(sig)
                if n >= GATHERED:
                    yield dealt(held)
                    held, n = [], 0
        if held:
            yield dealt(held)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_part(batches):
            sigs, nodes = [], []
            for r in part:
                ids = np.frombuffer(r["ids"], np.int64)
                with np.errstate(over="ignore"):
                    sigs.append(np.cumsum(unpacked(r["sigs"], U, r["n"]), dtype=U))
                nodes.append(ids[unpacked(r["local"], np.uint16 if len(ids) < 65536 else np.uint32, r["n"]).astype(np.int64)])
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            head = np.flatnonzero(new)
            lead = np.repeat(head, np.diff(np.append(head, len(sig))))
            edge = np.flatnonzero(node != node[lead])
            old = [np.frombuffer(b"".join(r[c] for r in part), np.int64) for c in ("e_sig", "e_a", "e_b")]
            new_ones = [sig[edge].view(np.int64), node[lead[edge]], node[edge]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(new_ones, old, strict=True)], ["sig", "a", "b"])

    parts = texts.select("id", "text").mapInArrow(sent, "part int, n int, sigs binary, local binary, ids binary, e_sig binary, e_a binary, e_b binary")
    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(met, "sig long, a long, b long")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    rows = (r for batch in batches for r in batch.to_pylist())
    for _, own in groupby(rows, key=lambda r: r["part"]):
        yield list(own)


def t_occurrence(lists: list[list[int]], least: int) -> dict[int, int]:
    """{record: lists it is in} for the records in at least `least` of the sorted lists, by DivideSkip.

    The `least` - 1 longest lists are set aside: a record in `least` of all must still be in one of the short ones, those of
    the rarest shingles. These are merged by a heap, and what they hold is looked up in the long ones by bisection, as long
    as the lists that are left can still make up what is missing.
    """
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < least or least < 1:
        return {}
    short, long = lists[: len(lists) - least + 1], lists[len(lists) - least + 1 :]
    found = {}
    for record, times in groupby(heapq.merge(*short)):
        n = sum(1 for _ in times)
        for left, x in zip(range(len(long) - 1, -1, -1), long, strict=True):
            i = bisect_left(x, record)
            n += i < len(x) and x[i] == record
            if n + left < least:
                break
        if n >= least:
            found[record] = n
    return found


def index_of(sets: list[np.ndarray]) -> dict[int, list[int]]:
    """Inverted lists: for each shingle the sets that hold it, in order."""
    out: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for x in s.tolist():
            out.setdefault(x, []).append(i)
    return out


def partners(query: np.ndarray, sizes: list[int], index: dict[int, list[int]], similar: tuple[int, int]) -> list[int]:
    """The indexed sets that are similar to the query."""
    num, den = similar
    n = len(query)
    hits = t_occurrence([index[x] for x in query.tolist() if x in index], -(-num * n // den))
    return [i for i, common in hits.items() if den * common >= num * (n + sizes[i] - common)]


class Lists:
    """Inverted lists of sets as flat arrays; for shingles that over half of the sets hold, the sets without them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        n, owner = len(sets), np.repeat(np.arange(len(sets)), self.sizes)
        self.values, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.common = 2 * np.bincount(at, minlength=len(self.values)) > n
        dense = self.common[at]
        without = np.ones((int(self.common.sum()), n), bool)
        without[(np.cumsum(self.common) - 1)[at[dense]], owner[dense]] = False
        which, lacks = np.nonzero(without)
        of = np.concatenate([at[~dense], np.flatnonzero(self.common)[which]])
        self.members = np.concatenate([owner[~dense], lacks])[np.argsort(of, kind="stable")]
        self.length = np.bincount(of, minlength=len(self.values))
        self.start = np.cumsum(self.length) - self.length

    def linked(self, queries: list[np.ndarray], similar: tuple[int, int]) -> np.ndarray:
        """Whether each query (row) is similar to each set (column)."""
        num, den = similar
        n, sizes = len(self.sizes), np.array([len(q) for q in queries], np.int64)
        flat, owner = np.concatenate(queries), np.repeat(np.arange(len(queries)), sizes)
        at = np.minimum(np.searchsorted(self.values, flat), len(self.values) - 1)
        hit = self.values[at] == flat
        at, owner = at[hit], owner[hit]
        postings = np.cumsum(self.length[at])
        shared = np.zeros((len(queries), n), np.int64)
        begin = 0
        while begin < len(queries):
            a = int(np.searchsorted(owner, begin))
            most = (postings[a - 1] if a else 0) + POSTINGS
            past = int(np.searchsorted(postings, most, "right"))
            end = max(begin + 1, int(owner[past]) if past < len(owner) else len(queries))
            x = slice(a, int(np.searchsorted(owner, end)))
            for kind in (False, True):
                own = self.common[at[x]] == kind
                lists, q = at[x][own], owner[x][own] - begin
                length = self.length[lists]
                place = np.repeat(self.start[lists] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                times = np.bincount(np.repeat(q, length) * n + self.members[place], minlength=(end - begin) * n).reshape(-1, n)
                shared[begin:end] += np.bincount(q, minlength=end - begin)[:, None] - times if kind else times
            begin = end
        return den * shared >= num * (sizes[:, None] + self.sizes - shared)


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    out = []
    for a, b, raw, offsets in slices(texts, SLICE):
        row, h = shingles(raw, offsets, size)
        out += np.split(h, np.searchsorted(row, np.arange(1, b - a)))
    return out


def _sketched(ids: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """id, key, n, bits of the texts with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column(2), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())], ["id", "key", "n", "bits"])

    return texts.join(ids, "id").select("id", "key", "text").mapInArrow(run, "id long, key binary, n long, bits binary")


def _closeness(n_a: np.ndarray, n_b: np.ndarray, differing: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    num, den = similar
    return (differing * (den + num) <= (n_a + n_b) * (den - num)) & (den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b))


def _close_pairs(pairs: DataFrame, sketches: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """a, b, a_key, b_key of the pairs of ids that sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a_bits").to_pylist(), batch.column("b_bits").to_pylist()
            differing = np.array([int(np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum()) for x, y in zip(a, b, strict=True)], np.int64)
            keep = _closeness(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy(), differing, similar)
            yield batch.select(["a", "b", "a_key", "b_key"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sketches.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("key", "n", "bits")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.mapInArrow(run, "a long, b long, a_key binary, b_key binary")


def _searched_stars(pairs: DataFrame, texts: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b, a_key, b_key) those that link: each a queries the index of its b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keys = batch.column("a_key").to_pylist()
                heads = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
                queries = _sets(batch.column("a_text").take(pa.array(heads, pa.int64())), size)
                sets = _sets(batch.column("b_text"), size)
                linked = []
                for i, j, query in zip(heads, [*heads[1:], len(keys)], queries, strict=True):
                    own = sets[i:j]
                    linked += [i + k for k in partners(query, [len(s) for s in own], index_of(own), similar)]
                yield batch.select(["a", "b", "a_key", "b_key"]).take(pa.array(sorted(linked), pa.int64()))

    side = lambda c: texts.select(F.col("id").alias(c), F.col("key").alias(f"{c}_key2"), F.col("text").alias(f"{c}_text"))
    both = pairs.join(side("b"), "b").where("b_key = b_key2").drop("b_key2").join(side("a"), "a").where("a_key = a_key2")
    return both.select("a", "b", "a_key", "b_key", "a_text", "b_text").mapInArrow(run, "a long, b long, a_key binary, b_key binary")


def _near(a: list[dict], b: list[dict], similar: tuple[int, int]) -> np.ndarray:
    """Of the rows of a, then of b: whether sketches leave a partner of another component, across a and b, or in a if b is empty."""
    rows = [*a, *b]
    bits, n = folded([r["bits"] for r in rows]), np.array([r["n"] for r in rows])
    _, part = np.unique(np.array([r["component"].hex() for r in rows]), return_inverse=True)
    keep = np.zeros(len(rows), bool)
    for i in range(len(a)):
        k = len(a) if b else i + 1
        differing = np.bitwise_count(bits[i] ^ bits[k:]).sum(1, dtype=np.int64)
        near = np.flatnonzero(_closeness(n[i], n[k:], differing, similar) & (part[k:] != part[i])) + k
        keep[near] = True
        keep[i] |= len(near) > 0
    return keep


def _searched_blocks(members: DataFrame, texts: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """a, b (keys) of links between components in buckets (sig, id, key, component, n, bits), each all against all.

    A bucket of more than BLOCK members is cut into blocks by hash, and each two blocks meet in one search. Sketches choose
    the members whose texts are needed; they are compared in one task across SKETCHED blocks on either side, so that few rows
    travel for it.
    """
    n = members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    wide, most = F.floor(F.col("own") / SKETCHED).cast("int"), F.ceil(F.col("blocks") / SKETCHED).cast("int")
    meet = F.explode(F.transform(F.sequence(F.lit(0), most - 1), lambda j: F.struct(F.least(wide, j).alias("i"), F.greatest(wide, j).alias("j"))))
    dealt = members.join(n, "sig").withColumn("own", own).withColumn("at", meet).select(F.xxhash64("sig", "at.i", "at.j").alias("task"), "at.i", "at.j", "own", "id", "key", "component", "n", "bits")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (task, i, j), rows in groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["task"], r["i"], r["j"])):
            blocks: dict[int, list[dict]] = {}
            for r in rows:
                blocks.setdefault(r["own"], []).append(r)
            for x in blocks:
                for y in blocks:
                    if x // SKETCHED == i and y // SKETCHED == j and x <= y:
                        a, b = blocks[x], blocks[y] if x != y else []
                        near = _near(a, b, similar)
                        need = [r for r, k in zip([*a, *b], near, strict=True) if k]
                        name = int(mix(np.array([(x << 32) + y], U) ^ np.array([task], np.int64).view(U)).view(np.int64)[0])
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(need), pa.int64()), *(pa.array([r[c] for r in need], k) for c, k in (("id", pa.int64()), ("key", pa.binary()), ("component", pa.binary())))], ["task", "id", "key", "component"])

    needed = dealt.repartition("task").sortWithinPartitions("task", "i", "j").mapInArrow(chosen, "task long, id long, key binary, component binary")
    needed = written(needed, "needed")
    # tasks with the same members need one search
    once = needed.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("of")).groupBy("n", "of").agg(F.min("task").alias("task"))
    rows = needed.join(once.select("task"), "task").join(texts.select("id", F.col("key").alias("key2"), "text"), "id").where("key = key2")
    rows = rows.select("task", "component", "key", "text").repartition("task").sortWithinPartitions("task", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def searched(task: list[dict]) -> list[tuple[bytes, bytes]]:
            sets = _sets(pa.array([r["text"] for r in task], pa.large_string()), size)
            bits, sizes = folded([sketch(x, 8) for x in sets]), np.array([len(x) for x in sets])
            up = {r["component"]: r["component"] for r in task}

            def root(x: bytes) -> bytes:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            out = []
            for i in range(1, len(sets)):
                differing = np.bitwise_count(bits[i] ^ bits[:i]).sum(1, dtype=np.int64)
                near = np.flatnonzero(_closeness(sizes[i], sizes[:i], differing, similar)).tolist()
                near = [k for k in near if root(task[k]["component"]) != root(task[i]["component"])]
                if near:
                    own = [sets[k] for k in near]
                    for k in partners(sets[i], [len(x) for x in own], index_of(own), similar):
                        x, y = root(task[near[k]]["component"]), root(task[i]["component"])
                        if x != y:
                            up[max(x, y)] = min(x, y)
                            out.append((task[i]["key"], task[near[k]]["key"]))
            return out

        for _, task in groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["task"]):
            found = searched(list(task))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def similar_texts(docs: DataFrame, text_col: str, size: int = WORDS, similar: tuple[int, int] = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """texts: key, n_shingles of each different text; groups: key, root of those linked to another, directly or on the way."""
    text = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # ids are 64-bit hashes; should two texts share one, both stay in the set and both are looked at
    same = text.groupBy(F.xxhash64("text").alias("id")).agg(F.collect_set("text").alias("texts")).select("id", F.explode("texts").alias("text"))
    texts = bucketed(same.withColumn("key", text_key(F.col("text"))), "id")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    stars = written(_stars(texts, size, similar, max(PARTS, 2 * chars // PART_CHARS).bit_length() - 1), "stars")
    members = stars.select("sig", F.explode(F.array("a", "b")).alias("id")).distinct()
    degree = members.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    hubs = members.join(degree, "id").groupBy("sig").agg(F.max(F.struct("n", "id")).alias("hub"))
    hung = written(members.join(hubs, "sig").select("sig", F.col("hub.id").alias("a"), F.col("id").alias("b")), "hung")
    pairs = hung.where("a <> b").select("a", "b").distinct()
    sketches = written(_sketched(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), texts, size), "sketches")
    linked = written(_searched_stars(_close_pairs(pairs, sketches, similar), texts, size, similar), "linked")
    links = linked.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    groups = written(components(links), "groups")
    # buckets with a member that doesn't link to the hub, and their components
    open_sigs = hung.where("a <> b").join(linked.select("a", "b").distinct(), ["a", "b"], "left_anti").select("sig").distinct()
    members = hung.select("sig", F.col("b").alias("id")).join(open_sigs, "sig")
    named = sketches.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("root", "key"))
    shape = members.join(named.select("id", "component"), "id").groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("of"), F.min("component").alias("x"), F.max("component").alias("y"))
    chosen = shape.where(F.col("x") != F.col("y")).groupBy("n", "of").agg(F.min("sig").alias("sig")).select("sig")  # one of buckets with the same members
    asked = members.join(written(chosen, "buckets"), "sig").join(named.select("id", "key", "component", "n", "bits"), "id")
    more = _searched_blocks(asked, texts, size, similar)
    return texts, components(links.unionByName(more))


def _links_of(texts: DataFrame, known: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """__key, __links: how many rows of other texts each text that has such links to, of texts known as (__key, __root, __id, __copies).

    A component of two is one link. In larger ones each two blocks of BLOCK texts meet once, a text's sets being made once and
    sent PACK at a time.
    """
    shape = known.groupBy("__root").agg(F.count(F.lit(1)).alias("m"), F.sum("__copies").alias("rows")).where("m > 1")
    shape = shape.withColumn("__root", F.when(F.col("__root").isNotNull(), F.col("__root")))  # as in _components_of
    members = written(known.join(shape, "__root"), "members")
    two = members.where("m = 2").select("__key", (F.col("rows") - F.col("__copies")).alias("__links"))
    pack = F.pmod(F.xxhash64("__key"), F.ceil(F.col("m") / PACK)).cast("int")
    larger = members.where("m > 2").select(F.col("__id").alias("id"), F.col("__key").alias("key"), F.col("__copies").alias("copies"), F.col("__root").alias("root"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), pack.alias("pack"))
    # equal keys as two inequalities: as an equality it would join the join's keys, which the texts aren't laid out by
    rows = larger.join(texts.select("id", F.col("key").alias("key2"), "text"), "id").where("key <= key2 and key >= key2")
    rows = rows.select("root", "pack", "blocks", "key", "copies", "text").repartition("root", "pack").sortWithinPartitions("root", "pack")

    def pack_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    sets = _sets(batch.column("text"), size)
                    yield from zip(*(batch.column(c).to_pylist() for c in ("root", "pack", "blocks", "key", "copies")), sets, strict=True)

        for (root, k, blocks), own in groupby(read(), key=lambda r: r[:3]):
            own = list(own)
            n = np.array([len(r[5]) for r in own], np.int64)
            values, local = np.unique(np.concatenate([r[5] for r in own]), return_inverse=True)
            local = local[np.lexsort((local, np.repeat(np.arange(len(own)), n)))].astype(np.uint32)
            cols = [root, k % blocks, blocks, b"".join(r[3] for r in own), np.array([r[4] for r in own], np.int64).tobytes(), n.tobytes(), len(values), packed(np.diff(values, prepend=U(0))), packed(np.diff(local, prepend=np.uint32(0)))]
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds, strict=True)], ["root", "own", "blocks", "keys", "copies", "n", "n_values", "of_values", "local"])

    packs = rows.mapInArrow(pack_up, "root binary, own int, blocks int, keys binary, copies binary, n binary, n_values long, of_values binary, local binary")
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    dealt = packs.withColumn("at", meet).select("root", "at.i", "at.j", "own", "keys", "copies", "n", "n_values", "of_values", "local")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "own")

    def opened(rows: list[dict]) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
        keys, sets = [], []
        for r in rows:
            n = np.frombuffer(r["n"], np.int64)
            with np.errstate(over="ignore"):
                values = np.cumsum(unpacked(r["of_values"], U, r["n_values"]), dtype=U)
                local = np.cumsum(unpacked(r["local"], np.uint32, int(n.sum())), dtype=np.uint32)
            sets += np.split(values[local], np.cumsum(n)[:-1])
            keys += [r["keys"][k : k + 20] for k in range(0, len(r["keys"]), 20)]
        return keys, np.frombuffer(b"".join(r["copies"] for r in rows), np.int64), sets

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lambda keys, n: pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64())], ["__key", "__links"])
        for (_, i, j), task in groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["root"], r["i"], r["j"])):
            task = list(task)
            a = [r for r in task if r["own"] == i]
            b = [r for r in task if r["own"] == j]
            if not a or not b:  # a block that got no text
                continue
            keys, copies, sets = opened(a)
            if i == j:
                yield found(keys, Lists(sets).linked(sets, similar) @ copies - copies)
            else:
                other_keys, other_copies, other_sets = opened(b)
                linked = Lists(other_sets).linked(sets, similar)
                yield found(keys, linked @ other_copies)
                yield found(other_keys, copies @ linked)

    counted = dealt.mapInArrow(search, "__key binary, __links long").groupBy("__key").agg(F.sum("__links").alias("__links"))
    return two.unionByName(counted)


def jaccard_groups(docs: DataFrame, id_col: str, text_col: str, size: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """docs with n_shingles long, n_links long: the other rows that link with it, and component_id: the least id reachable by links, its own included.

    Words are lower-cased in A-Z. Two documents link when their sets of `size`-word shingles have a Jaccard similarity of
    similar[0] / similar[1] or more. A text with fewer words has its sequence as its only shingle; null texts and texts
    without words have none and link with nothing, copies of them neither. Other copies link, repeated rows among them. Null
    ids are passed over for the least id; a component of null ids alone has null. An empty table gives none. Columns that
    bear the names of the three give way.
    """
    more = ("n_shingles", "n_links", "component_id")
    docs, names, (id_col, text_col) = numbered(docs, id_col, text_col, added=more)
    texts, groups = similar_texts(docs, text_col, size, similar)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in slices(batch.column(1), SLICE):
                row, _ = shingles(raw, offsets, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.bincount(row, minlength=b - a).astype(np.int64))], ["__key", "n_shingles"])

    sizes = texts.select("key", "text").mapInArrow(count, "__key binary, n_shingles long")
    rows = docs.withColumn("__key", text_key(F.col(text_col)))
    each = written(_components_of(rows, groups, id_col, F.count(F.lit(1)).alias("__copies"), F.first(F.xxhash64(text_col)).alias("__id")), "components")
    links = _links_of(texts, each, size, similar)
    known = sizes.join(each, "__key").join(links, "__key", "left").withColumn("__links", F.col("__copies") - 1 + F.coalesce("__links", F.lit(0)))
    out = rows.join(known.drop("__id", "__copies", "__root"), "__key", "left")
    worded = F.col("n_shingles") > 0
    return out.select(*docs.columns, F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), F.when(worded, F.col("__links")).otherwise(F.lit(0)).alias("n_links"), F.when(worded, F.col("__component")).otherwise(F.col(id_col)).alias("component_id")).toDF(*names, *more)


def _components_of(rows: DataFrame, groups: DataFrame, id_col: str, *more: Column) -> DataFrame:
    """__key, __root, __component: each text's component by its least text's key and its least id; and more aggregates of its rows."""
    least = rows.groupBy("__key").agg(F.min(id_col).alias("__least"), *more)
    rooted = least.join(groups.select(F.col("node").alias("__key"), F.col("root").alias("__root")), "__key", "left").withColumn("__root", F.coalesce("__root", "__key"))
    whole = rooted.groupBy("__root").agg(F.min("__least").alias("__component"))
    whole = whole.withColumn("__root", F.when(F.col("__root").isNotNull(), F.col("__root")))  # dealt out anew: Spark can split a large group
    return rooted.join(whole, "__root").select("__key", "__root", "__component", *least.columns[2:])


def one_of_each(docs: DataFrame, id_col: str, text_col: str, size: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """docs with one row of each group of similar or equal texts: the one with the least id.

    Rows without words, and other rows that link with nothing, all stay. Where several rows of a group bear its least id,
    whole copies or not, one of them stays. Of a group without any id one row stays; an empty table gives none.
    """
    docs, names, (id_col, text_col) = numbered(docs, id_col, text_col)
    texts, groups = similar_texts(docs, text_col, size, similar)
    wordless = F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    rows = docs.withColumn("__key", text_key(F.col(text_col))).withColumn("__id", F.xxhash64(text_col)).withColumn("__wordless", wordless)
    light = rows.drop(text_col)
    marked = light.join(_components_of(rows, groups, id_col), "__key", "left")
    stay = marked.where(F.col("__wordless") | F.col(id_col).eqNullSafe(F.col("__component")))
    several = written(stay.where(~F.col("__wordless")).groupBy("__root").agg(F.count(F.lit(1)).alias("n"), F.min("__key").alias("k")).where("n > 1"), "several")
    if not several.isEmpty():  # ids that repeat in a group: one row for each, by least key, then any of equal rows
        again = several.select(F.col("__root").alias("__r"), "k")
        own = stay["__root"] == again["__r"]
        plain = stay.join(again, own & ~F.col("__wordless"), "left_anti")
        first = stay.where(~F.col("__wordless")).join(again, own & (F.col("__key") == F.col("k")), "left_semi")
        stay = plain.unionByName(first.dropDuplicates(["__root"]))
    # texts come from the table that is laid out by their hash, and don't move again
    own = texts.select(F.col("id").alias("__id"), F.col("key").alias("__k"), F.col("text").alias(text_col))
    return stay.join(own, (stay["__id"] == own["__id"]) & (stay["__key"] == own["__k"]), "left").select(*docs.columns).toDF(*names)
