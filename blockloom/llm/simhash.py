"""SimHash near-dedup (operator 2): exact comparison of fingerprints in tiles.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, shingles are space-joined words
(repeats count; fewer words: the whole sequence; none: fingerprint zero), hashed by XXH64, seed
42. A bit of the fingerprint is one if it is in over half the hashes.

``tile_links`` compares two tiles by numpy exclusive-or and bit counts. Both are sorted by
population count and cut into sub-tiles; pairs of sub-tiles whose counts differ beyond the
radius are skipped, for such fingerprints cannot be within it. Which tiles meet:

* ``components_by_radius`` (small radius, the fingerprint alone decides). The 64 bits are cut into 5
  blocks; two fingerprints within 3 bits agree on 2 blocks at least. For each of the 10 pairs of
  blocks, fingerprints with equal blocks form a tile. A tile of over TILE rows is dealt into
  chunks, and chunks meet in pairs as separate groups. Of a group's links only a spanning forest
  leaves the task, so n copies give n links at most. Nothing is lost, whatever the skew.
* ``near_duplicates`` (shingles of 5 words, similarity 0.8). At this similarity fingerprints differ in
  15% of the bits, so no blocks agree for sure. Tiles are made by BANDS bands of BAND_ROWS least values each of the set of distinct
  shingles, mixed anew for every value: two sets of similarity s agree on a band with probability s ** BAND_ROWS, and meet in a tile for every band
  that they agree on. At 0.8 all bands fail for 0.0005 of the pairs, at 0.9 for one in a million. The
  fingerprint has 128 bits here (the second half from the same hashes, mixed) and is that of the distinct shingles, as the
  similarity is: how often a passage repeats changes neither. Documents with any fingerprint of their tile within
  WIDE_RADIUS bits are candidates (the radius misses another 0.001 of pairs at exactly 0.8, by the binomial law); their shingle sets then go to
  the tiles where they met one, and a link needs a true Jaccard similarity of s, looked at in the first band that the two sets share.
  What a tile holds follows from likeness, not from the size of the corpus. Equal sets are one (its
  smallest document stands for all), so copies fill no tile; a tile of very many different sets is dealt into chunks that meet in pairs.
  Sets of up to SMALL shingles have too few votes for a bit, so they are linked without fingerprints and without loss
  (``_small_links``): similar sets share one of their first shingles, rare ones first, and meet by it.

Fingerprints equal to another's are compared once, null texts count as empty, null ids come last, repeated rows get equal
results. Empty tables give no rows. Near-duplicates: texts without words link to nothing. Columns besides id and text are not read, and
may have any name. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, few, id_of, keyed, materialize, pieces, ragged, spans_of, text_of, unused
from .rolling import mix

TILE = 4096
SUB_TILE = 512
#: Groups of up to so many rows are compared many at a time.
LITTLE = 64
SEED = 42
WIDE_RADIUS = 33
BANDS, BAND_ROWS = 14, 4
#: Rounds of components; they grow with the logarithm of the longest chain, so this is beyond any table.
MOST_ROUNDS = 200
SMALL = 32
#: A shingle of over so many small sets stands behind the rarer ones of its sets.
COMMON = 64
TILE_BYTES = 16 << 20
_seeds = np.random.default_rng(20240611).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([h(join(z), SEED) for z in zip(*[w[i:] for i in range(k)])], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _signed(fps) -> pa.Array:
    return pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())


def bands_of(h: np.ndarray) -> np.ndarray:
    """A number for each band of a set of shingle hashes."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for i in range(0, len(h), 1 << 12):  # bounded memory for very long texts
            part = h[i : i + (1 << 12)]
            np.minimum(least, ((part[None, :] ^ _seeds[0][:, None]) * _seeds[1][:, None]).min(axis=1), out=least)
        out = np.zeros(BANDS, np.uint64)
        for row in least.reshape(BANDS, BAND_ROWS).T:
            out = mix(out + row)
    return out


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fps = [fingerprint(shingle_hashes(t, k)) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _signed(fps)], names=["doc_id", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


SKETCH = "row long, n long, same binary, fp long, fp2 long, bands binary, names array<long>"


def sketches(texts: DataFrame, k: int, named: int) -> DataFrame:
    """texts: row, text. Of each set of distinct shingles: their number, a 128-bit digest of the set, 128 bits of fingerprint, the bands, and the set itself where it has at most ``named``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for row, t in zip(b.column("row").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                if len(h := np.unique(shingle_hashes(t, k))):
                    rows.append((row, len(h), hashlib.blake2b(h.astype("<u8").tobytes(), digest_size=16).digest(), fingerprint(h), fingerprint(mix(h)), bands_of(h).astype("<u8").tobytes(), h.view(np.int64) if len(h) <= named else None))
            row, n, same, fp, fp2, bands, names = zip(*rows) if rows else [()] * 7
            columns = [pa.array(row, pa.int64()), pa.array(n, pa.int64()), pa.array(same, pa.binary()), _signed(fp), _signed(fp2), pa.array(bands, pa.binary()), pa.array(names, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SKETCH.split(", ")])

    return texts.mapInArrow(run, SKETCH)


def tile_links(a: list[np.ndarray], b: list[np.ndarray] | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a and b within the radius, sub-tile by sub-tile; of a with itself, each pair once, given b None. a, b: the 64-bit parts of the fingerprints."""
    same = b is None
    count = lambda parts: sum(np.bitwise_count(p).astype(np.int64) for p in parts)
    ca = count(a)
    oa = np.argsort(ca, kind="stable")
    ob, cb = (oa, ca) if same else (np.argsort(count(b), kind="stable"), count(b))
    sa, sb = [p[oa] for p in a], [p[ob] for p in (a if same else b)]
    ca, cb = ca[oa], cb[ob]
    for i in range(0, len(oa), SUB_TILE):
        end = min(i + SUB_TILE, len(oa))
        # beyond these bit counts no fingerprint can be within the radius
        j0 = max(int(np.searchsorted(cb, ca[i] - radius)), i if same else 0)
        j1 = int(np.searchsorted(cb, ca[end - 1] + radius, side="right"))
        for j in range(j0, j1, SUB_TILE):
            stop = min(j + SUB_TILE, j1)
            apart = np.bitwise_count(sa[0][i:end, None] ^ sb[0][None, j:stop])
            for x, y in zip(sa[1:], sb[1:]):
                apart += np.bitwise_count(x[i:end, None] ^ y[None, j:stop])
            r, c = np.nonzero(apart <= radius)
            r, c = r + i, c + j
            if same:
                r, c = r[r < c], c[r < c]
            if len(r):
                yield oa[r], ob[c]


class Forest:
    """Union-find over the rows of a group; whole arrays of links are looked at by numpy before any is followed."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def flatten(self) -> np.ndarray:
        """The root of every row."""
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up

    def unite(self, r: np.ndarray, c: np.ndarray, verify: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
        """Of the links those that join two trees (and stand the test)."""
        root, out = self.flatten(), []
        a, b = root[r], root[c]
        apart = np.flatnonzero(a != b)
        if verify is None and len(apart):  # of all links between two trees one will do
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            apart = apart[np.unique(low * len(root) + high, return_index=True)[1]]
        for i, j in zip(r[apart].tolist(), c[apart].tolist()):
            x, y = self.root(i), self.root(j)
            if x != y and (verify is None or verify(i, j)):
                self.up[max(x, y)] = min(x, y)
                out.append((i, j))
        return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
    """Groups of a stream sorted by keys: many groups of up to LITTLE rows in one table, with their sizes, or a larger one alone."""
    ready: list[pa.RecordBatch] = []
    sizes: list[np.ndarray] = []
    held: list[pa.RecordBatch] = []
    last = None

    def closed() -> pa.Table | None:
        """The group at hand is whole: a large one is handed over, a little one waits."""
        n = sum(x.num_rows for x in held)
        if n > LITTLE:
            return pa.Table.from_batches(held)
        if n:
            ready.extend(held)
            sizes.append(np.array([n]))
        return None

    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
        bounds = np.concatenate(([0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [b.num_rows]))
        at = 0
        if k[:, 0].tolist() == last:  # goes on with the group at hand
            held.append(b.slice(0, int(bounds[1])))
            at = 1
        if len(bounds) - 1 > at:
            if (large := closed()) is not None:
                yield large, None
            own = np.diff(bounds)
            while at < len(own) - 1:  # runs of little groups at once
                big = np.flatnonzero(own[at:-1] > LITTLE)
                stop = at + int(big[0]) if len(big) else len(own) - 1
                if stop > at:
                    ready.append(b.slice(int(bounds[at]), int(bounds[stop] - bounds[at])))
                    sizes.append(own[at:stop])
                if len(big):
                    yield pa.Table.from_batches([b.slice(int(bounds[stop]), int(own[stop]))]), None
                    stop += 1
                at = stop
            held, last = [b.slice(int(bounds[-2]))], k[:, -1].tolist()
        if sum(x.num_rows for x in ready) >= 1 << 15:
            yield pa.Table.from_batches(ready), np.concatenate(sizes)
            ready, sizes = [], []
    if (large := closed()) is not None:
        yield large, None
    if ready:
        yield pa.Table.from_batches(ready), np.concatenate(sizes)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of an edge: large-star and small-star rounds until nothing changes. Each round is written to the shared folder, and the one before goes."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    before = None
    for _ in range(MOST_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, name)
        discard(e)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(small.distinct(), name)
        discard(large)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components not found within {MOST_ROUNDS} rounds")


def _parts(table: pa.Table) -> list[np.ndarray]:
    return [table.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2") if c in table.column_names]


def _links(node: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])


def _pairs(table: pa.Table, sizes: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group within the radius: those of side 0 against side 1, or all among themselves where a tile meets itself."""
    parts, side = _parts(table), table.column("side").to_numpy()
    if sizes is None:
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for r, c in tile_links([p[first] for p in parts], [p[second] for p in parts] if len(second) else None, radius):
            yield first[r], (second if len(second) else first)[c]
        return
    own = np.arange(len(side))
    many = np.repeat(np.cumsum(sizes), sizes) - own - 1
    r, c = np.repeat(own, many), ragged(own + 1, many)
    same = table.column("p").to_numpy() == table.column("q").to_numpy()
    apart = sum(np.bitwise_count(p[r] ^ p[c]).astype(np.int64) for p in parts)
    near = (apart <= radius) & (same[r] | (side[r] != side[c]))
    yield r[near], c[near]


def _forest(table: pa.Table, sizes: np.ndarray | None, radius: int) -> pa.RecordBatch:
    """Spanning links of each group."""
    node, out = table.column("node").to_numpy(), []
    forest = Forest(len(node))
    for r, c in _pairs(table, sizes, radius):
        out += forest.unite(r, c)
    return _links(node, out)


def _block_masks(blocks: int, agree: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (y - x)) - 1) << x for x, y in zip(edges, edges[1:])]
    masks = [sum(c) for c in itertools.combinations(one, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def components_by_radius(nodes: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """nodes: (node, fp), one row for each fingerprint. (node, component) of nodes with links."""
    masks = _block_masks(radius + 2, 2)
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    rows = nodes.select("node", "fp", key.alias("k")).select("node", "fp", "k.c", "k.key")
    rows = _in_chunks(rows, ["c", "key"], F.count("*") / tile, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in _groups(batches, ["c", "key", "p", "q"]):
            yield _forest(table, sizes, radius)

    # records are short: larger batches
    return components(materialize(rows.mapInArrow(run, "a long, b long"), "simhash-links", 16000), "simhash-components")


def _in_chunks(rows: DataFrame, keys: list[str], chunks: Column, deal: str) -> DataFrame:
    """Rows whose key has company, by key and pair of chunks (p, q): a key's rows are dealt to as many chunks as the aggregate says, and every chunk meets every other."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.ceil(chunks).cast("int").alias("m")).where("n > 1").select(*keys, "m")
    rows = rows.join(counts, keys).withColumn("own", F.pmod(F.xxhash64(deal), F.col("m")).cast("int"))
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least("own", j).alias("p"), F.greatest("own", j).alias("q"))))
    rows = rows.withColumn("t", met).withColumns({"p": F.col("t.p"), "q": F.col("t.q"), "side": F.when(F.col("own") == F.col("t.p"), 0).otherwise(1)}).drop("t", "own", "m")
    return rows.repartition(*keys, "p", "q").sortWithinPartitions(*keys, "p", "q")


def simhash_groups(docs: DataFrame, k: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable; null if none has an id) of every document. The fingerprints themselves are the nodes."""
    own = materialize(fingerprints(docs, k, id_col, text_col), "fingerprints")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components_by_radius(nodes.select(F.col("fp").alias("node"), "fp"), radius)
    named = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(least, "component").select("fp", "component_id"), "named")
    out = own.hint("merge").join(named, "fp")
    out = materialize(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "simhash")
    discard(own, nodes, named)
    return out


def _set_links(t: pa.Table, similarity: float) -> pa.RecordBatch:
    """Spanning links of the similar sets of one group: each set counts what it shares with all others by their common shingles."""
    node, names = t.column("node").to_numpy(), t.column("names").combine_chunks()
    size = names.value_lengths().to_numpy().astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    name = np.unique(names.flatten().to_numpy(), return_inverse=True)[1]
    holders = np.repeat(np.arange(len(node)), size)[np.argsort(name, kind="stable")]
    first = np.concatenate(([0], np.cumsum(np.bincount(name))))
    left, out = np.ones(len(node), bool), []
    for start in range(len(node)):
        seen = [start] if left[start] else []
        left[start] = False
        while seen:
            i = seen.pop()
            common = np.bincount(np.concatenate([holders[first[x] : first[x + 1]] for x in name[at[i] : at[i + 1]]]), minlength=len(node))
            alike = np.flatnonzero(left & (common >= similarity * (size[i] + size - common)))
            left[alike] = False
            seen.extend(alike.tolist())
            out.extend((i, j) for j in alike.tolist())
    return _links(node, out)


def _small_links(own: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join all similar small sets. own: node, names. Equal sets are one; of a set of n, the first n - s n + 1 shingles hold one of any set of similarity s."""
    small = own.where(F.col("names").isNotNull()).select("node", "names")
    sets = materialize(small.groupBy("names").agg(F.min("node").alias("rep")), "small-sets")
    copies = small.hint("merge").join(sets, "names").where("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    words = sets.select(F.col("rep").alias("node"), F.explode("names").alias("h"))
    common = materialize(words.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > COMMON), "small-common")
    ranked = words.join(few(common), "h", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h"))).alias("s"))
    reach = F.size("s") - F.ceil(F.size("s") * similarity - 1e-9).cast("int") + 1
    rows = materialize(ranked.select("node", F.col("s.h").alias("names"), F.explode(F.slice("s.h", F.lit(1), reach)).alias("h")), "small-keys")
    rows = _in_chunks(rows, ["h"], F.count("*") / tile, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in _groups(batches, ["h", "p", "q"]):
            at = [0, table.num_rows] if sizes is None else spans_of(sizes).tolist()
            for x, y in zip(at, at[1:]):
                if y - x > 1:
                    yield _set_links(table.slice(x, y - x), similarity)

    return copies.unionByName(rows.mapInArrow(run, "a long, b long"))


def near_groups(texts: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    """texts: row, text. (row, component) of every row with words; of one set's rows the first stands for all while links are sought."""
    own = materialize(sketches(texts, k, math.floor(SMALL / similarity + 1e-9)), "sketches")
    first = own.groupBy("same").agg(F.min("row").alias("node"))
    member = materialize(own.select("row", "same").join(first, "same").select("row", "node"), "members")
    sets = own.join(member.where("row == node").select("row"), "row").withColumnRenamed("row", "node").drop("same")
    sets = materialize(sets, "sets")
    discard(own)
    small = materialize(_small_links(sets, similarity), "small-links", 16000)

    large = sets.where(F.col("n") > SMALL).select("node", "n", "fp", "fp2", "bands")
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.xxhash64(F.substring("bands", 8 * i + 1, 8)).alias("key")) for i in range(BANDS)]))
    in_band = materialize(large.select("node", band.alias("k")).select("node", "k.c", "k.key"), "bands")
    company = in_band.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1").select("c", "key")
    rows = _in_chunks(in_band.join(company, ["c", "key"]).join(large, "node"), ["c", "key"], F.count("*") / TILE, "node")

    def close(table: pa.Table, sizes: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that this tile has to look at: within the radius, of sizes that can be similar, and no earlier band shared."""
        n, c = table.column("n").to_numpy(), table.column("c").to_numpy()
        bands = np.frombuffer(b"".join(table.column("bands").to_pylist()), "<u8").reshape(-1, BANDS)
        for r, s in _pairs(table, sizes, radius):
            near = np.minimum(n[r], n[s]) >= similarity * np.maximum(n[r], n[s])
            r, s = r[near], s[near]
            near = (bands[r] == bands[s]).argmax(axis=1) == c[r]
            yield r[near], s[near]

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in _groups(batches, ["c", "key", "p", "q"]):
            hit = np.zeros(table.num_rows, bool)
            for r, s in close(table, sizes):
                hit[r] = hit[s] = True
            yield from table.select(["node", "c", "key"]).filter(pa.array(hit)).to_batches()

    found = materialize(rows.mapInArrow(seek, "node long, c int, key long").distinct(), "candidates", 16000)
    discard(in_band)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            names = [np.unique(shingle_hashes(t, k)).astype("<u8").tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(names, pa.binary())], names=["node", "names"])

    nodes = materialize(found.select("node").distinct(), "candidate-nodes")
    full = materialize(texts.join(few(nodes.select(F.col("node").alias("row"))), "row", "left_semi").mapInArrow(named, "node long, names binary"), "shingle-sets")
    rows = _in_chunks(found.join(large, "node").join(full, "node"), ["c", "key"], F.greatest(F.count("*") / TILE, F.sum("n") * 8 / TILE_BYTES), "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in _groups(batches, ["c", "key", "p", "q"]):
            node, column = table.column("node").to_numpy(), table.column("names").combine_chunks()
            forest, out = Forest(len(node)), []

            def names(i: int, column: pa.Array = column) -> np.ndarray:
                return np.frombuffer(column[i].as_buffer(), "<u8")

            def alike(i: int, j: int) -> bool:
                x, y = sorted((names(i), names(j)), key=len)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                return common >= similarity * (len(x) + len(y) - common)

            for r, s in close(table, sizes):
                out += forest.unite(r, s, alike)
            yield _links(node, out)

    links = materialize(rows.mapInArrow(link, "a long, b long"), "large-links")
    discard(full, found, nodes, sets)
    found = components(small.unionByName(links), "near-components")
    return member.join(found, "node", "left").select("row", F.coalesce("component", "node").alias("component"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that have a near duplicate with a smaller id in their group (of rows without a smaller one, one stays)."""
    row = unused(docs, "row")
    late = unused(docs, "late")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(late, id_of(id_col).isNull()), "numbered")
    texts = rows.select(F.col(row).alias("row"), text_of(text_col).alias("text"))
    groups = materialize(near_groups(texts, k, similarity, radius), "near-groups")
    several = groups.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    member = groups.join(several, "component").withColumnRenamed("row", row).join(rows.select(F.col(row), id_of(id_col).alias("id"), F.col(late).alias("late")), row)
    stays = member.groupBy("component").agg(F.min(F.struct("late", "id", F.col(row).alias("row"))).alias("first"))
    gone = materialize(member.join(stays, "component").where(F.col(row) != F.col("first.row")).select(row), "near-gone")
    out = materialize(rows.join(few(gone), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]), "apart")
    discard(rows, groups, gone)
    return out
