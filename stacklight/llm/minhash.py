"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. A document's set is its distinct 5-word shingles (64-bit hashes). Documents with the same set collapse to one class by the
   set's digest, so exact copies cost one row each from here on.
2. SuperMinHash: every element draws, round by round, one place of its own random permutation of the m slots and a value in
   [round, round + 1); a slot keeps its least value. A document stops when all its slots lie below the next round. 48 bands of 5
   slots miss a pair of similarity 0.75 with a chance of 2e-6.
3. Classes that share a band are tied to the least class of that band; the components of these ties are candidate clusters. No
   true link crosses clusters, no pairs are listed.
4. Inside a cluster, links are found on the full sets with an inverted index over its shingles: expanding a document counts its
   shared shingles with all others at once. Union-find takes the smallest unfinished group first and stops when one is left, so
   a large group of copies needs few expansions. A cluster is verified in tiles: its classes are cut into blocks by set size
   (sizes that differ by more than the similarity allows never link, so such blocks don't meet) and by hash, and a tile is a pair
   of blocks. The tiles of a cluster are separate rows of the shuffle; a small cluster is one block and one tile. The links that
   the tiles find, one spanning forest each, are joined by the components of step 3.

Cases: null, empty and word-less texts have no shingles and link with nothing; texts of one to four words have one shingle; equal
texts are one class; rows with one doc_id are one vertex, so their groups merge; rows with a null doc_id keep a null component,
link nothing and are not kept; an empty table gives no rows; further columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, powers, shingle_hashes, text_bytes
from .components import connected_components

BANDS, ROWS = 48, 5
GOLDEN = 0x9E3779B97F4A7C15
#: Elements that are drawn for at a time.
BATCH = 4096
#: What a class weighs besides its shingles; the least and the most weight of a block; blocks into which a cluster in between is cut.
ROW_WEIGHT, LEAST_BLOCK, MOST_BLOCK, BLOCKS = 256, 32_768, 2_000_000, 24


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A signature of m uint64 (round << 32 | value) for each non-empty set."""
    h = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    waiting: dict[bool, list] = {False: [], True: []}

    def draw(pieces: list[tuple[int, np.ndarray]]) -> None:
        seed = np.concatenate([x for _, x in pieces])
        doc = np.repeat([i for i, _ in pieces], [len(x) for _, x in pieces])
        ids = np.unique(doc)
        place = np.tile(np.arange(m, dtype=np.uint16), (len(seed), 1))
        act = np.arange(len(seed))
        flat = h.reshape(-1)
        most = np.zeros(len(sets), np.uint64)
        for j in range(m):
            r = mix64(seed[act] + np.uint64((j + 1) * GOLDEN & 0xFFFFFFFFFFFFFFFF))
            k = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
            slot = place[act, k]
            place[act, k] = place[act, j]
            np.minimum.at(flat, doc[act] * m + slot, np.uint64(j << 32) | (r >> np.uint64(32)))
            most[ids] = h[ids].max(1)
            act = act[most[doc[act]] >= np.uint64((j + 1) << 32)]
            if not len(act):
                return
            ids = np.unique(doc[act])

    size = {False: 0, True: 0}
    for i, s in enumerate(sets):
        for lo in range(0, len(s), BATCH):
            short = len(s) < BATCH // 16
            waiting[short].append((i, s[lo : lo + BATCH]))
            size[short] += len(waiting[short][-1][1])
            if size[short] >= BATCH:
                draw(waiting[short])
                waiting[short], size[short] = [], 0
    for pieces in waiting.values():
        if pieces:
            draw(pieces)
    return h


def band_keys(h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band of each signature."""
    c = powers(rows + 1)
    return mix64(sum(mix64(h[:, r : bands * rows : rows] + c[r]) * c[rows - r] for r in range(rows))).view(np.int64)


def signatures(docs: DataFrame, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (null: no shingles), bands."""

    def run(batches):
        for b in batches:
            sets = [shingle_hashes(t, width) for t in b.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            for lo in range(0, len(full), 512):
                part = full[lo : lo + 512]
                for i, k in zip(part, band_keys(superminhash([sets[i] for i in part], bands * rows), bands, rows), strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def linked(inter, n, m, percent: int):
    return 100 * inter >= percent * (n + m - inter)


def exact_groups(ids: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """For each of the sets, the least id of its component in the graph of all exact links between them."""
    n = len(ids)
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    if n == 2:
        if linked(len(np.intersect1d(*sets, assume_unique=True)), len(sets[0]), len(sets[1]), percent):
            up[1] = 0
    elif n > 2:
        lens = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(n, dtype=np.int32), lens)
        _, inv = np.unique(np.concatenate(sets), return_inverse=True)
        by = np.argsort(inv, kind="stable")
        posting = owner[by]
        df = np.bincount(inv)
        first = np.cumsum(df) - df
        start = np.cumsum(lens) - lens
        open_members = {i: [i] for i in range(n)}
        heap = [(1, i) for i in range(n)]
        size = [1] * n
        while len(open_members) > 1:
            k, r = heapq.heappop(heap)
            if r not in open_members or size[r] != k or root(r) != r:
                continue
            if not open_members[r]:
                del open_members[r]
                continue
            i = open_members[r].pop()
            own = inv[start[i] : start[i] + lens[i]]
            own = own[df[own] > 1]
            count = df[own]
            at = np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            inter = np.bincount(posting[at], minlength=n)
            for j in np.flatnonzero(linked(inter, lens[i], lens, percent) & (inter > 0)):
                a, b = root(i), root(int(j))
                if a != b:
                    if size[a] < size[b]:
                        a, b = b, a
                    up[b] = a
                    size[a] += size[b]
                    open_members[a] = open_members.get(a, []) + open_members.pop(b, [])
            heapq.heappush(heap, (size[root(i)], root(i)))
    least: dict[int, int] = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(n)]


def tiles(members: DataFrame, percent: int, least: int, most: int, blocks: int) -> DataFrame:
    """members (cluster, rep, n, ...) with the keys of the tiles of each: an array, tile."""
    # sizes of linked sets differ by a factor of 100 / percent at most, so by one size class
    ratio = math.log(1.001 * 100 / percent)
    rows = members.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int"))
    sizes = rows.groupBy("cluster", "size").agg(F.sum(F.col("n") + ROW_WEIGHT).alias("weight"))
    plan = sizes.groupBy("cluster").agg(F.sum("weight").alias("weight"), F.map_from_entries(F.collect_list(F.struct("size", "weight"))).alias("sizes"))
    block = F.least(F.greatest(F.col("weight") / blocks, F.lit(least)), F.lit(most))
    plan = plan.where(F.col("weight") > least).select("cluster", F.transform_values("sizes", lambda _, w: F.ceil(w / block).cast("int")).alias("cut"))
    plan = materialize(plan, "minhash-plan")
    at = lambda size: F.coalesce(F.try_element_at("cut", size), F.lit(0))
    own = F.pmod(F.xxhash64("rep"), F.greatest(at(F.col("size")), F.lit(1))).cast("int")
    key = lambda size, x, other, y: F.xxhash64("cluster", size, x, other, y)
    all_of = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<bigint>"))
    size = F.col("size")
    same = all_of(at(size), lambda x: key(size, F.least(x, F.col("own")), size, F.greatest(x, F.col("own"))))
    above = all_of(at(size + 1), lambda x: key(size, F.col("own"), size + 1, x))
    below = all_of(at(size - 1), lambda x: key(size - 1, x, size, F.col("own")))
    out = rows.join(plan.hint("merge"), "cluster", "left").withColumn("own", own)
    return out.withColumn("tile", F.when(F.col("cut").isNull(), F.array(F.xxhash64("cluster"))).otherwise(F.concat(same, above, below))).drop("size", "cut", "own")


def _groups(sets: DataFrame, percent: int) -> DataFrame:
    """(tile, rep, shingles binary) -> (a, b): ties of each class to the least of its component in the tile."""

    def run(batches):
        now, ids, held = None, [], []

        def emit():
            pairs = [(i, c) for i, c in zip(ids, exact_groups(ids, held, percent), strict=True) if i != c]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["a", "b"])

        for b in batches:
            for tile, rep, s in zip(*(b.column(c).to_pylist() for c in ("tile", "rep", "shingles")), strict=True):
                if tile != now:
                    yield from emit()
                    now, ids, held = tile, [], []
                ids.append(rep)
                held.append(np.frombuffer(s, np.uint64))
        yield from emit()

    return sets.repartition("tile").sortWithinPartitions("tile", "rep").select("tile", "rep", "shingles").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS, least_block: int = LEAST_BLOCK, most_block: int = MOST_BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    signed = materialize(signatures(docs, text, width, bands, rows), "minhash-signed")
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes, "minhash-classes")

    banded = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("band", "key", "hub")
    ties = banded.join(hubs.hint("merge"), ["band", "key"]).where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = connected_components(ties)
    members = materialize(classes.select("digest", "rep", "n").join(clusters, classes.rep == clusters.id).select("digest", "rep", "n", F.col("component").alias("cluster")), "minhash-members")
    dealt = materialize(tiles(members, percent, least_block, most_block, blocks).select("digest", "rep", "tile"), "minhash-tiles")

    def load(batches):
        for b in batches:
            out = []
            for tile, rep, want, t in zip(*(b.column(c).to_pylist() for c in ("tile", "rep", "digest", "text")), strict=True):
                s = shingle_hashes(t, width)
                if digest(s) == want:
                    out.append((tile, rep, s.tobytes()))
            for lo in range(0, len(out), 1000):
                part = out[lo : lo + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in part], t) for i, t in enumerate((pa.list_(pa.int64()), pa.int64(), pa.binary()))], names=["tile", "rep", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_bytes(text).alias("text"))
    # the members grow with the corpus: a merge join at every size, never a broadcast
    sets = texts.join(dealt.hint("merge"), "rep").select("tile", "rep", "digest", "text").mapInArrow(load, "tile array<long>, rep long, shingles binary")
    links = _groups(sets.select(F.explode("tile").alias("tile"), "rep", "shingles"), percent)
    # rows of one doc_id with different sets are one vertex
    found = connected_components(links)
    comp = classes.select("digest", "rep").join(found, classes.rep == found.id, "left").select("digest", F.coalesce("component", "rep").alias("of_class"))
    comp = materialize(comp, "minhash-components")
    out = signed.select("doc_id", "n_shingles", "digest").join(comp, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
