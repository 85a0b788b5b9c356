"""N-gram Jaccard join with a prefix tree.

A document's set holds its distinct word n-grams; two documents link where
``100 * shared >= percent * union``.  The result is every document's component.

Texts with equal sets are one class throughout, named by 128 bits of the set.  All
n-grams have one global order: those that at most ``hot_from`` sets hold (cold) by
hash, then the others (hot), rarest first; how many sets hold an n-gram is counted
over all n-grams of all rows.  Let need(n) = ceil(percent * n / 100).  A set's
prefix is its first n - need(n) + spare(n) n-grams; two linked sets share at least
min(spare(n1), spare(n2)) n-grams of both prefixes.  So

1. two sets that may link either share that many cold prefix n-grams, or a hot
   one.  A class of which too few prefix n-grams are shared at all can have no
   partner: it stays alone and its text is not looked at again;
2. of the others, those that share enough cold n-grams are tied (a cold n-gram is
   in few sets, so these pairs are few for each set), and those that share a hot
   n-gram are tied to the least of its holders; the classes that are tied, directly
   or not, are a family.  Two linked classes are always in one family;
3. a family of bounded size is one cell; a larger one is cut by size of set, and
   sets of like size are dealt to cells of bounded size.  Every cell is joined by
   the trie below, with a few sets that all cells near it hold (pivots), which
   brings most of a large family into one component;
4. sets of a large family's largest component need not meet again.  The others, its
   stragglers, are dealt to cells of their own; these are joined by the trie with
   every cell of the family that may hold linked sets (by size), with each other
   and within themselves, so no link between components is missed and the work
   grows with the stragglers times the family, not with the family's square.

The trie holds the sets of a cell, each ordered with the cell's common n-grams
first, as paths; n-grams without a branch are one node.  A probe walks down it,
counts what it shares with a node once for all sets below, and leaves a subtree
when the shared n-grams so far and the remaining lengths cannot reach the
threshold any more, or when all sets below are known to be connected with it.

What is broadcast: the hot n-grams, at most ``HOT_LIMIT`` (beyond that, only the
most frequent count as hot, which changes the order but no result), and a bitmap of
``FILTER_BITS`` that leaves out most texts of step 1 before they are read again
(what it lets pass too much is joined out).

Defined results: null, empty and blank texts have no n-grams and are linked with
nothing; with fewer than n words the whole sequence is one n-gram; repeated ids
and rows are kept as they come; a null id is never a component's smallest id
unless all its ids are null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernel import BLANK_PARTED, LOWER, discard, lean, mix, settle, shingle_hashes, string_buffers, word_hashes

NGRAM = 4
PERCENT = 85
SPARE_EVERY = 25
HOT_FROM = 8
HOT_LIMIT = 1_000_000
FILTER_BITS = 25
#: What a cell may weigh: its n-grams, and SET_WEIGHT for each set.
CELL = 1 << 18
SET_WEIGHT = 512
#: Sets whose sizes differ by this factor at most are in one band.
BAND = 0.05
TEXT_BYTES = 4 << 20
#: n-grams that a task gathers before it deals them out.
PACK = 1 << 19


def need(n: int, percent: int) -> int:
    """The least number of n-grams that a set of n shares with any linked set."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    return 1 + n // SPARE_EVERY


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - need(n, percent) + spare(n))


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted set of n-gram hashes of each text; texts are taken a few MB at a time (one at least)."""
    raw, offs = string_buffers(column)
    first = 0
    while first < len(offs) - 1:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + TEXT_BYTES, "right")) - 1)
        words, _, bounds = word_hashes(raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first], BLANK_PARTED, LOWER)
        grams, at = shingle_hashes(words, bounds, k)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            own = np.sort(grams[a:b])
            yield own[np.append(True, own[1:] != own[:-1])] if b - a > 1 else own
        first = last


def set_id(own: np.ndarray) -> bytes:
    """128 bits that name a set: two sums over its n-grams, mixed in different ways."""
    seed = np.uint64(len(own) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    sums = np.array([mix(own + seed).sum(dtype=np.uint64), mix(~own ^ seed).sum(dtype=np.uint64)], np.uint64)
    return mix(sums + seed).tobytes()


class _Seen:
    """Names met lately, so that copies within a task are handled once; forgetting only repeats work."""

    def __init__(self, most: int = 1 << 16):
        self.most, self.names = most, set()

    def add(self, name: bytes) -> bool:
        if name in self.names:
            return False
        if len(self.names) >= self.most:
            self.names.clear()
        self.names.add(name)
        return True


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each n-gram, by its upper half; sorted n-grams have sorted buckets."""
    return ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _low(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The rows bounds[i]:bounds[i+1] of an array as binary values."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64) * width), pa.py_buffer(values.reshape(-1).view(np.uint8))]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray, kind) -> np.ndarray:
    return string_buffers(column)[0].view(kind)


def _names(ids: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as 16 bytes each."""
    return _packed(ids, np.arange(len(ids) + 1))


def _buckets(df: DataFrame) -> int:
    """Four for each shuffle partition: what one holds stays bounded as long as the partitions do."""
    return max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _hot_grams(texts: DataFrame, k: int, hot_from: int, hot_limit: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ranks) of the n-grams that more than hot_from sets hold, by key; a key is an n-gram's bucket and low half, a rank its place among the hot, rarest first."""

    def deal(grams: np.ndarray) -> pa.RecordBatch:
        found, counts = np.unique(grams, return_counts=True)
        once = counts == 1
        ones, many = found[once], found[~once]
        edges = np.arange(buckets + 1)
        parts = [np.searchsorted(_bucket(x, buckets), edges) for x in (ones, many)]
        columns = [_packed(_low(ones), parts[0]), _packed(_low(many), parts[1]), _packed(counts[~once].astype(np.uint32), parts[1])]
        return pa.RecordBatch.from_arrays([pa.array(edges[:-1], pa.int32()), *columns], names=["bucket", "ones", "many", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = _Seen(), [], 0
        for batch in batches:
            for own in _sets(batch.column(0), k):
                if len(own) and seen.add(set_id(own)):
                    held.append(own)
                    size += len(own)
                if size >= PACK:
                    yield deal(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield deal(np.concatenate(held))

    def add_up(part: pa.Table) -> pa.Table:
        ones, many, times = (_unpacked(part[c], np.uint32) for c in ("ones", "many", "times"))
        keys = np.concatenate([ones, many])
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], np.concatenate([np.ones(len(ones), np.uint32), times])[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        total = np.add.reduceat(weights, first, dtype=np.int64) if len(keys) else first
        hot = total > hot_from
        bucket = part["bucket"][0].as_py() if len(part) else 0
        return pa.table({"key": keys[first[hot]].astype(np.int64) | np.int64(bucket << 32), "n": total[hot]})

    counts = texts.select("text").mapInArrow(lean(run), "bucket int, ones binary, many binary, times binary").groupBy("bucket").applyInArrow(add_up, "key long, n long")
    counts = settle(counts, "hot")
    steps = [hot_from << i for i in range(40)]
    sizes = counts.agg(*[F.count(F.when(F.col("n") > s, 1)).alias(f"s{i}") for i, s in enumerate(steps)]).first()
    limit = next(s for i, s in enumerate(steps) if sizes[i] <= hot_limit)
    got = counts.where(F.col("n") > limit).select("key", "n").toPandas()
    discard(counts)
    keys, n = got["key"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    ranks = np.empty(len(keys), np.int32)
    ranks[np.lexsort((keys, n))] = np.arange(len(keys))
    order = np.argsort(keys)
    return keys[order].astype(np.uint64), ranks[order]


def _prefix(own: np.ndarray, hot: tuple[np.ndarray, np.ndarray], buckets: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(cold, hot) n-grams of the prefix."""
    size = prefix_length(len(own), percent)
    keys, ranks = hot
    if not len(keys):
        return own[:size], own[:0]
    key = (_bucket(own, buckets) << np.uint64(32)) | (own & np.uint64(0xFFFFFFFF))
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    is_hot = keys[at] == key
    cold, warm = own[~is_hot][:size], own[is_hot]
    return cold, warm[np.lexsort((warm, ranks[at[is_hot]]))[: size - len(cold)]]


def _signatures(texts: DataFrame, k: int, percent: int, hot: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Per row: id, sid, n, cold (packed) and hot prefix n-grams (null where this task has given them for the same set)."""
    hot_grams = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            sids, sizes, colds, hots = [], [], [], []
            for own in _sets(batch.column(1), k):
                sid = set_id(own) if len(own) else None
                sids.append(sid)
                sizes.append(len(own))
                fresh = sid is not None and seen.add(sid)
                cold, warm = _prefix(own, hot_grams.value, buckets, percent) if fresh else (None, None)
                colds.append(cold.tobytes() if fresh else None)
                hots.append(warm.view(np.int64) if fresh else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(colds, pa.binary()), pa.array(hots, pa.list_(pa.int64()))], names=["id", "sid", "n", "cold", "hot"])

    made = settle(texts.mapInArrow(lean(run), f"id {texts.schema['id'].dataType.simpleString()}, sid binary, n long, cold binary, hot array<long>"), "signatures")
    hot_grams.destroy()
    return made


def _shared_cold(rows: DataFrame, buckets: int) -> DataFrame:
    """g, sid, n: the cold prefix n-grams that several classes hold.

    An n-gram that hot_from sets hold at most, as each task counts them, so a bucket has no large group.
    """

    def deal(grams: list[np.ndarray], ids: list[bytes], sizes: list[int]) -> pa.RecordBatch:
        lengths = list(map(len, grams))
        g = np.concatenate(grams)
        order = np.argsort(g)
        owner = np.repeat(np.arange(len(grams)), lengths)[order]
        g = g[order]
        bounds = np.searchsorted(_bucket(g, buckets), np.arange(buckets + 1))
        names = np.frombuffer(b"".join(ids), np.uint64).reshape(-1, 2)
        columns = [_packed(g, bounds), _packed(names[owner], bounds), _packed(np.array(sizes, np.uint32)[owner], bounds)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int32()), *columns], names=["bucket", "grams", "ids", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, ids, sizes, held = [], [], [], 0
        for batch in batches:
            for sid, n, cold in zip(*(batch.column(i).to_pylist() for i in range(3))):
                grams.append(np.frombuffer(cold, np.uint64))
                ids.append(sid)
                sizes.append(n)
                held += len(grams[-1])
                if held >= PACK:
                    yield deal(grams, ids, sizes)
                    grams, ids, sizes, held = [], [], [], 0
        if grams:
            yield deal(grams, ids, sizes)

    def meet(part: pa.Table) -> pa.Table:
        g, sizes = _unpacked(part["grams"], np.uint64), _unpacked(part["sizes"], np.uint32)
        ids = _unpacked(part["ids"], np.uint64).reshape(-1, 2)
        order = np.lexsort((ids[:, 1], ids[:, 0], g))
        g, ids, sizes = g[order], ids[order], sizes[order]
        fresh = np.append(True, (g[1:] != g[:-1]) | (ids[1:] != ids[:-1]).any(1))[: len(g)]
        g, ids, sizes = g[fresh], ids[fresh], sizes[fresh]
        same = g[1:] == g[:-1]
        shared = (np.append(same, False) | np.append(False, same))[: len(g)]
        return pa.table({"g": pa.array(g[shared].view(np.int64)), "sid": _names(ids[shared]), "n": pa.array(sizes[shared].astype(np.int64))})

    listed = rows.where("octet_length(cold) > 0").select("sid", "n", "cold")
    return settle(listed.mapInArrow(lean(run), "bucket int, grams binary, ids binary, sizes binary").groupBy("bucket").applyInArrow(meet, "g long, sid binary, n long"), "shared", [rows])


def _id_bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the hashed ids (column spot), packed; made slice by slice in Spark."""
    slices = 32
    width = (1 << FILTER_BITS) // slices

    def pack(part: pa.Table) -> pa.Table:
        bits = np.zeros(width, bool)
        bits[np.asarray(part["at"])] = True
        return pa.table({"slice": part["slice"].slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    spots = ids.select("spot").distinct().select(F.floor(F.col("spot") / width).cast("int").alias("slice"), (F.col("spot") % width).alias("at"))
    whole = np.zeros((slices, width // 8), np.uint8)
    for row in spots.groupBy("slice").applyInArrow(pack, "slice int, bits binary").collect():
        whole[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return whole.reshape(-1)


def _full_sets(texts: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """sid, grams (packed 64-bit n-grams, sorted) of the sets wanted (id, sid), once for each task at most."""
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)).alias("spot")
    bitmap = texts.sparkSession.sparkContext.broadcast(_id_bitmap(wanted.where("id is not null").select(spot)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            at = np.asarray(batch.column(0))
            keep = np.asarray(batch.column(1)) | ((bitmap.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            sids, packed = [], []
            for own in _sets(batch.column(2).filter(pa.array(keep)), k):
                sid = set_id(own)
                if len(own) and seen.add(sid):
                    sids.append(sid)
                    packed.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(packed, pa.binary())], names=["sid", "grams"])

    made = texts.select(spot, F.col("id").isNull().alias("nameless"), "text").mapInArrow(lean(run), "sid binary, grams binary")
    sets = settle(made.join(wanted.select("sid"), "sid", "left_semi"), "sets")
    bitmap.destroy()
    return sets


class PrefixTree:
    """Ordered sets as paths; a node is a run of n-grams without a branch."""

    __slots__ = ("grams", "rank", "runs", "children", "below", "ending", "longest", "least", "sizes", "order")

    def __init__(self, sets: list[np.ndarray]):
        grams, counts = np.unique(np.concatenate(sets), return_counts=True)
        self.grams, self.rank = grams, np.empty(len(grams), np.int64)
        self.rank[np.lexsort((grams, -counts))] = np.arange(len(grams))  # common first, so that paths are shared
        paths = [np.sort(self.rank[np.searchsorted(grams, s)]) for s in sets]
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].tolist())
        ordered = [paths[i] for i in self.order]
        self.sizes = np.array([len(p) for p in ordered])
        self.runs: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.below: list[tuple[int, int]] = []
        self.ending: list[int] = []  # below[0] : ending are the sets that end with the node
        self.longest: list[int] = []
        self.least: list[int] = []
        self._grow(ordered)

    def _grow(self, paths: list[np.ndarray]) -> None:
        """Nodes for ranges of paths that are equal up to a depth; an explicit stack, as sets may be deep."""
        todo = [(0, len(paths), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            first, last = paths[lo], paths[hi - 1]
            m = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:m] != last[depth:m])
            stop = depth + int(differ[0]) if len(differ) else m
            node = len(self.runs)
            self.runs.append(first[depth:stop])
            self.children.append([])
            self.below.append((lo, hi))
            self.longest.append(int(self.sizes[lo:hi].max()) - stop)
            self.least.append(int(self.sizes[lo:hi].min()))
            if parent >= 0:
                self.children[parent].append(node)
            i = lo
            while i < hi and len(paths[i]) == stop:
                i += 1
            self.ending.append(i)
            while i < hi:
                j = i + 1
                while j < hi and paths[j][stop] == paths[i][stop]:
                    j += 1
                todo.append((i, j, stop, node))
                i = j

    def path(self, own: np.ndarray) -> np.ndarray:
        """The n-grams of a set that the tree knows, in its order."""
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        return np.sort(self.rank[at[self.grams[at] == own]])

    def probe(self, me: np.ndarray, mine: int, percent: int, skip) -> Iterator[int]:
        """The places of all sets that link with a set of `mine` n-grams whose path is me; skip(lo, hi): none of these is wanted."""
        todo = [(0, 0, 0)]
        while todo:
            node, shared, passed = todo.pop()
            lo, hi = self.below[node]
            if skip(lo, hi):
                continue
            run = self.runs[node]
            if len(run):
                a = int(np.searchsorted(me, run[0]))
                b = int(np.searchsorted(me, run[-1], "right"))
                if b > a:
                    part = me[a:b]
                    shared += int((run[np.minimum(np.searchsorted(run, part), len(run) - 1)] == part).sum())
                passed = b
            # 100 * s >= percent * (x + y - s) must be possible for the smallest set below
            rest = min(len(me) - passed, self.longest[node])
            if (100 + percent) * (shared + rest) < percent * (mine + self.least[node]):
                continue
            for k in range(lo, self.ending[node]):
                if (100 + percent) * shared >= percent * (mine + int(self.sizes[k])):
                    yield k
            for child in self.children[node]:
                todo.append((child, shared, passed))


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: int, j: int) -> bool:
        a, b = self.up[i], self.up[j]
        if a == b:
            return False
        self.up[self.up == max(a, b)] = min(a, b)
        return True


def join_cell(packed: list[bytes], known: list, percent: int, probing: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (places of two sets) that connect the sets of a cell as all its links would; known: components known so far (equal where connected).

    probing: which of them are held against the others, if not all against all.
    """
    sets = [np.frombuffer(p, np.uint64) for p in packed]
    targets = np.arange(len(sets)) if probing is None else np.flatnonzero(~probing)
    tree = PrefixTree([sets[i] for i in targets])
    at = targets[tree.order]  # the set at each place of the tree
    probes = at if probing is None else np.flatnonzero(probing)
    forest = _Forest(len(sets))
    first: dict = {}
    for i, c in enumerate(known):
        forest.join(first.setdefault(c, i), i)
    links = []
    for place, i in enumerate(probes.tolist()):
        if (forest.up[at] == forest.up[i]).all():
            continue
        before = place + 1 if probing is None else 0  # pairs with earlier probes are done
        skip = lambda lo, hi: hi <= before or bool((forest.up[at[lo:hi]] == forest.up[i]).all())  # noqa: B023, E731
        for k in tree.probe(tree.path(sets[i]), len(sets[i]), percent, skip):
            j = int(at[k])
            if j != i and forest.join(i, j):
                links.append((i, j))
    return links


def _joined_cells(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """rows: keys, sid, known, probing (null: all against all), grams.  a, b: links."""

    def run(part: pa.Table) -> pa.Table:
        by = {sid: i for i, sid in enumerate(part["sid"].to_pylist())}  # a set may come from several tasks
        sids = sorted(by)
        part = part.take(pa.array([by[s] for s in sids], pa.int64()))
        probing = None if part["probing"].null_count else np.asarray(part["probing"]).astype(bool)
        few = len(sids) < 2 or (probing is not None and (probing.all() or not probing.any()))
        links = [] if few else join_cell(part["grams"].to_pylist(), part["known"].to_pylist(), percent, probing)
        return pa.table({"a": pa.array([sids[i] for i, _ in links], pa.binary()), "b": pa.array([sids[j] for _, j in links], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(run, "a binary, b binary")


def candidates(rows: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """sid, n, family: the classes that may have partners; two that may link are in one family.  rows: as _signatures gives them; shared: as _shared_cold does."""
    warm = rows.where("size(hot) > 0").select("sid", "n", "hot").dropDuplicates(["sid"])
    tally = shared.select("sid", "n", F.lit(1).alias("c")).unionByName(warm.select("sid", "n", F.size("hot").alias("c"))).groupBy("sid").agg(F.min("n").alias("n"), F.sum("c").alias("c"))
    hopeful = settle(tally.where(F.col("c") >= F.expr(f"1 + floor(floor(({percent} * n + 99) / 100) / {SPARE_EVERY})")).select("sid", "n"), "hopeful", [rows, shared])
    cold = shared.join(hopeful.select("sid"), "sid", "left_semi")
    x, y = (cold.select("g", F.col("sid").alias(s), F.col("n").alias(f"{s}_n")) for s in ("x", "y"))
    least, most = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    met = x.join(y, (x["g"] == y["g"]) & (F.col("x") < F.col("y")) & (least * 100 >= most * percent))
    ties = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.min(least).alias("n")).where(F.col("c") >= F.expr(f"1 + floor(n / {SPARE_EVERY})")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    held = warm.join(hopeful.select("sid"), "sid", "left_semi").select("sid", F.explode("hot").alias("g"))
    stars = held.join(held.groupBy("g").agg(F.min("sid").alias("b")), "g").select(F.col("sid").alias("a"), "b").distinct()
    families = connected_components(ties.unionByName(stars), of=[rows, shared])
    found = settle(hopeful.join(families, hopeful["sid"] == families["node"]).select("sid", "n", F.col("root").alias("family")), "candidates", [hopeful, families])
    discard(hopeful, families)
    return found


def in_cells(found: DataFrame, cell: int) -> DataFrame:
    """sid, n, family, band, cell, pivot: a family that weighs no more than a cell is one (band null), a larger one is cut into cells of like size of set."""
    weight = F.sum(F.col("n") + SET_WEIGHT)
    whole = found.groupBy("family").agg(weight.alias("weight"))
    rows = found.join(whole, "family").withColumn("band", F.when(F.col("weight") > cell, F.floor(F.log(F.col("n").cast("double")) / BAND))).drop("weight")
    bands = rows.where("band is not null").groupBy("family", "band").agg(F.ceil(weight / cell).alias("parts"), F.min("sid").alias("pivot"))
    rows = rows.join(bands, ["family", "band"], "left")
    name = F.concat_ws("-", F.hex("family"), "band", F.pmod(F.xxhash64("sid"), F.col("parts")))
    return rows.select("sid", "n", "family", "band", name.alias("cell"), (F.col("sid") == F.col("pivot")).alias("pivot"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = NGRAM, percent: int = PERCENT, hot_from: int = HOT_FROM, hot_limit: int = HOT_LIMIT, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), class_id (equal where the sets are)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = _buckets(docs)
    rows = _signatures(texts, k, percent, _hot_grams(texts, k, hot_from, hot_limit, buckets), buckets)
    shared = _shared_cold(rows, buckets)
    found = candidates(rows, shared, percent)
    discard(shared)
    state = settle(in_cells(found, cell), "cells", [found])
    places = rows.where("sid is not null").join(state.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.min("id").alias("id"))
    sets = _full_sets(texts, k, places)

    # every cell on its own, with the pivots of the bands near its own
    reach = math.ceil(math.log(100 / percent) / BAND) + 1
    pivots = state.where("pivot").select("family", F.col("band").alias("p_band"), "sid")
    cells = state.where("band is not null").select("family", "band", "cell").distinct()
    guests = cells.join(pivots, "family").where(F.abs(F.col("band") - F.col("p_band")) <= reach).select("cell", "sid")
    dealt = state.select("cell", "sid").unionByName(guests).distinct().join(sets, "sid").withColumns({"known": F.col("sid"), "probing": F.lit(None).cast("boolean")})
    links = settle(_joined_cells(dealt, ["cell"], percent), "met", [state, sets])
    known = connected_components(links, of=[links])

    # what the largest component of a large family does not hold yet, against the family
    large = state.where("band is not null").join(known.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "n", "family", "band", "cell", F.coalesce("root", "sid").alias("known"))
    large = settle(with_stragglers(large, cell), "large", [state, known])
    pairs = cell_pairs(large, reach, percent)
    alone = F.col("x") == F.col("y")
    sides = pairs.select("x", "y", F.explode(F.when(alone, F.array(F.lit(None).cast("boolean"))).otherwise(F.array(F.lit(True), F.lit(False)))).alias("probing"))
    sides = sides.withColumn("cell", F.when(F.col("probing"), F.col("x")).otherwise(F.col("y")))
    more = settle(_joined_cells(sides.join(large.select("sid", "cell", "known"), "cell").join(sets, "sid"), ["x", "y"], percent), "more")
    final = connected_components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), of=[known, more]) if more.take(1) else known

    smallest = rows.where("sid is not null").groupBy("sid").agg(F.min("id").alias("first"))
    placed = smallest.join(final.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    named = settle(placed.join(placed.groupBy("root").agg(F.min("first").alias("component")), "root").select("sid", "component"), "named", [rows])
    discard(found, state, sets, links, large, more, known, final)
    return rows.select("id", "sid", "n").join(named, "sid", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.hex("sid").alias("class_id"))


def with_stragglers(large: DataFrame, cell: int) -> DataFrame:
    """The sets of large families with a column straggler: not of the family's largest component.  Stragglers leave their cells for cells of their own.

    large: sid, n, family, band, cell, known (component so far).
    """
    sizes = large.groupBy("family", "known").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("family").agg(F.max(F.struct("c", "known"))["known"].alias("main"))
    rows = large.join(main, "family").withColumn("straggler", F.col("known") != F.col("main"))
    parts = rows.where("straggler").groupBy("family", "band").agg(F.ceil(F.sum(F.col("n") + SET_WEIGHT) / cell).alias("parts"))
    own = F.concat_ws("-", F.lit("s"), F.hex("family"), "band", F.pmod(F.xxhash64("sid"), F.col("parts")))
    rows = rows.join(parts, ["family", "band"], "left")
    return rows.select("sid", "n", "family", "band", F.when(F.col("straggler"), own).otherwise(F.col("cell")).alias("cell"), "known", "straggler")


def cell_pairs(large: DataFrame, reach: int, percent: int) -> DataFrame:
    """x, y: a cell of stragglers and any other cell of its family whose sizes fit, or itself; two cells of stragglers once, and only if they hold different components.

    large: as with_stragglers gives it.  Sets of the largest component need not meet each other.
    """
    about = large.groupBy("family", "band", "cell", "straggler").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("known").alias("lo"), F.max("known").alias("hi"))
    x, y = (about.select("family", *[F.col(c).alias(f"{s}_{c}") for c in ("band", "cell", "straggler", "least", "most", "lo", "hi")]) for s in ("x", "y"))
    near = (F.abs(F.col("x_band") - F.col("y_band")) <= reach) & (F.col("x_most") * 100 >= F.col("y_least") * percent) & (F.col("y_most") * 100 >= F.col("x_least") * percent)
    apart = F.least("x_lo", "y_lo") != F.greatest("x_hi", "y_hi")
    once = ~F.col("y_straggler") | (F.col("x_cell") <= F.col("y_cell"))
    return x.where("x_straggler").join(y, (x["family"] == y["family"]) & once & near & apart).select(F.col("x_cell").alias("x"), F.col("y_cell").alias("y"))
