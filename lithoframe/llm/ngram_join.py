"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

Texts become sets of hashed five-word shingles, equal sets collapse to one row, and each set gets a
label of DEPTH MinHash values for each tree of a forest. A label is one sortable number, 16 bits a value, so
a prefix of it is a node of the tree's trie. Sets under a common node are candidates: first under nodes
of the full depth; then the matched prefix is shortened until links as little similar as the least similar
one found so far are expected to be found with the target recall.

Candidates of a node meet in tiles: first with their labels only, to leave out members without a new
partner of about their size, then with their whole shingle sets, which are intersected. Tasks give counts of
links and edges of spanning trees, never lists of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import discard, staged, trimmed
from lithoframe.llm.components import connected_components
from lithoframe.llm.groups import Forest, bounds, runs, spread, tiled

#: Words of a shingle, similarity, trees, values of a label (8 at most), expected share of links found.
WORDS, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 20, 6, 0.9999
#: Members and shingles of a block at most, about; bytes of text that are shingled at once.
BLOCK, BLOCK_SHINGLES, PIECE = 1024, 1 << 21, 4 << 20
#: Shingles of all sets that are sorted and intersected at once, about.
AT_ONCE = 1 << 19
TILE = ["tree", "hi", "lo", "tile_i", "tile_j"]
#: Bins of similarity from the threshold to 1 in which found links are counted.
BINS = 40

_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def found_share(similarity: np.ndarray | float, depth: int, trees: int):
    """Chance that a pair shares a prefix of depth values in some tree."""
    return 1 - (1 - np.asarray(similarity, dtype=np.float64) ** depth) ** trees


def next_depth(found: np.ndarray, threshold: float, trees: int, depth: int, recall: float) -> int | None:
    """The prefix length to shorten to, or None if that of now reaches the recall.

    found[b] counts the links in bin b of similarity. The recall has to hold for the least similar links there
    are, so a few links near the threshold are not outvoted by many copies: the longest shorter prefix
    that finds such a link with that chance is taken, one value if none does.
    """
    some = np.flatnonzero(found)
    if not len(some) or depth <= 1:
        return None
    least = threshold + (1 - threshold) * some[0] / BINS  # the lower end of the bin
    enough = [d for d in range(depth, 0, -1) if found_share(least, d, trees) >= recall]
    to = enough[0] if enough else 1
    return to if to < depth else None


def masks(depth: int) -> tuple[int, int]:
    """What of a label's two numbers is its prefix of depth values."""
    top = lambda n: -(1 << (64 - 16 * n)) if n > 0 else 0
    return top(min(depth, 4)), top(depth - 4)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start offset, 64-bit hash) of each word of the bytes; words are parted by ASCII white space."""
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return start, np.zeros(0, dtype=np.uint64)
    last = ~space
    last[:-1] &= space[1:]
    end = np.flatnonzero(last) + 1
    # Place-dependent sums over each word: bytes are weighted by a power of an odd number by place.
    place = np.arange(len(raw), dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(raw)]])))
    power = _powers(int(place.max()) + 1)
    value = _BYTE[raw] * power[place]
    value[space] = 0
    total = np.add.reduceat(value, start)
    return start, mixed(total + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15))
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of every run of `words` words, or of all if fewer."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE):
            size += len(texts[to]) + 1
            to += 1
        some = texts[at:to]
        raw = np.frombuffer(b" ".join(some) + b" ", dtype=np.uint8)
        start, h = word_hashes(raw)
        edge = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in some])]))
        s = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
        for k in range(words):
            s = mixed(s + h[k : k + len(s)] + np.uint64(k + 1))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            n = hi - lo
            if n >= words:
                out.append(np.unique(s[lo : hi - words + 1]))
            elif n:
                one = np.zeros(1, dtype=np.uint64)
                for k in range(n):
                    one = mixed(one + h[lo + k : lo + k + 1] + np.uint64(k + 1))
                out.append(one)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        at = to
    return out


def labels_of(sets: list[np.ndarray], trees: int, depth: int, seed: int = 2) -> np.ndarray:
    """(sets, 2 * trees) numbers: the labels' first four values and the others; the sets must not be empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)
    size = np.asarray([len(s) for s in sets])
    flat, start = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)[:-1]])
    out = np.zeros((len(sets), 2 * trees), dtype=np.uint64)
    for t in range(trees):
        for d in range(depth):
            k = t * depth + d
            x = (flat ^ b[k]) * a[k]
            x ^= x >> np.uint64(32)
            least = mixed(np.minimum.reduceat(x * a[k], start)) >> np.uint64(48)
            out[:, 2 * t + d // 4] |= least << np.uint64(48 - 16 * (d % 4))
    return out.view(np.int64)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """(2, sets) numbers that tell sets apart; 0 for an empty one."""
    n = np.asarray([len(s) for s in sets], dtype=np.int64)
    full = np.flatnonzero(n)
    out = np.zeros((2, len(sets)), dtype=np.uint64)
    if len(full):
        flat, start = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(n[full])[:-1]])
        out[0, full] = mixed(np.add.reduceat(mixed(flat ^ np.uint64(11)), start) + n[full].astype(np.uint64))
        out[1, full] = mixed(np.add.reduceat(mixed(flat ^ np.uint64(29)), start))
    return out.view(np.int64)


def signatures(texts: DataFrame, trees: int, depth: int, words: int) -> DataFrame:
    """(doc_id, th, text) -> doc_id, th, shingles (count), fp1, fp2 (of the set), labels; null when no words."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                sets = shingle_sets(some.column("text").cast(pa.binary()).to_pylist(), words)
                n = np.asarray([len(s) for s in sets], dtype=np.int64)
                fp, labels = fingerprints(sets), [None] * len(sets)
                if n.any():
                    for i, row in zip(np.flatnonzero(n), labels_of([s for s in sets if len(s)], trees, depth), strict=True):
                        labels[i] = row
                none = n == 0
                yield pa.record_batch({
                    "doc_id": some.column("doc_id"), "th": some.column("th"), "shingles": pa.array(n),
                    "fp1": pa.array(fp[0], mask=none), "fp2": pa.array(fp[1], mask=none), "labels": pa.array(labels, pa.list_(pa.int64())),
                })

    return texts.mapInArrow(trimmed(turn), "doc_id long, th long, shingles long, fp1 long, fp2 long, labels array<long>")


def link(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, kept.

    Two rows are linked when the Jaccard similarity of their sets of `words`-word shingles is at least
    threshold (lower case; words are parted by ASCII white space; a text of fewer words is one shingle
    of them all). n_links counts the other rows a row is linked to, copies included; class_id is the
    smallest id reachable over links, and kept marks it. Texts that are null or have no words link with
    nothing, not even one another. Rows that repeat an id, with the same text or another, are separate rows.
    Rows with a null id are linked and counted as any; they are kept only where class_id is null, which it is
    if no row of the class has an id. Extra columns don't matter; an empty table gives no rows.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.lower(F.col(text)), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    signed = staged(signatures(texts.select("doc_id", "th", "text"), trees, DEPTH, words), "near-signatures")
    full = signed.filter("shingles > 0")
    # One row a set, numbered; of its rows, (id, hash of the text) tells where its text is.
    sets = full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("th", "doc_id", "shingles", "labels")).alias("one"))
    sets = staged(sets.select(F.monotonically_increasing_id().alias("rep"), "fp1", "fp2", "least", "copies", "one.*"), "near-sets")
    links, depth, longer = [], DEPTH, None
    found = np.zeros(BINS)
    while depth is not None:
        links.append(_links_at(sets, texts, depth, longer, threshold, words, trees))
        for row in links[-1].filter("bin is not null").groupBy("bin").agg(F.sum("links").alias("n")).collect():  # BINS at most
            found[row.bin] += row.n
        depth, longer = next_depth(found, threshold, trees, depth, recall), depth
    pairs = links[0].filter("bin is null")
    for more in links[1:]:
        pairs = pairs.union(more.filter("bin is null"))
    counts = pairs.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(pairs.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    least = components.join(sets.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("class_id"))
    classes = components.join(least, "component").select("rep", "class_id", F.lit(True).alias("linked"))
    told = sets.join(counts, "rep", "left").join(classes, "rep", "left")
    told = staged(told.select("fp1", "fp2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("least")).alias("class_id")), "near-told")
    mine = full.select("doc_id", "fp1", "fp2").join(told, ["fp1", "fp2"]).select("doc_id", "class_id", "n_links")
    rest = signed.filter("shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return mine.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()))


def _links_at(sets: DataFrame, texts: DataFrame, depth: int, longer: int | None, threshold: float, words: int, trees: int) -> DataFrame:
    """Links of sets that share a prefix of `depth` values in some tree, but none of `longer` values (met before).

    (rep, links, root, null): links of a set in a tile, copies counted, and the end of a spanning edge;
    (null, links, null, bin): linked pairs of sets by similarity.
    """
    hi, lo = masks(depth)
    number = lambda at, mask: F.element_at("labels", at).bitwiseAND(F.lit(mask).cast("long"))
    nodes = F.array(*[F.struct(F.lit(t).alias("tree"), number(2 * t + 1, hi).alias("hi"), number(2 * t + 2, lo).alias("lo")) for t in range(trees)])
    node = ["tree", "hi", "lo"]
    dealt = sets.select("rep", "shingles", F.explode(nodes).alias("node")).select("rep", "shingles", "node.*")
    crowded = dealt.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("weight")).filter("n > 1")
    crowded = staged(crowded.select(*node, F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).alias("blocks")), "near-nodes")
    met = dealt.join(crowded, node).join(sets.select("rep", "labels"), "rep")
    tiles = tiled(met.select(*node, "rep", "blocks", "shingles", "labels"), "rep", F.col("blocks"))

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, TILE):
            at = bounds(table, TILE)
            keep = [a + _candidates(table.slice(int(a), int(b - a)), trees, threshold, depth, longer) for a, b in zip(at[:-1], at[1:], strict=True) if b - a > 1]
            if keep:
                yield from table.select([*TILE, "side", "rep"]).take(pa.array(np.concatenate(keep))).combine_chunks().to_batches()

    # Only members with a partner of about their size that nothing before has brought get their sets.
    kinds = "tree int, hi long, lo long, tile_i int, tile_j int"
    met = staged(spread(tiles.select(*TILE, "side", "rep", "shingles", "labels"), TILE, hopeful, f"{kinds}, side int, rep long"), "near-members")
    wanted = sets.join(met.select("rep").distinct(), "rep", "left_semi")
    places = wanted.select(F.col("doc_id").alias("at_id"), F.col("th").alias("at_th")).hint("merge")  # texts are dealt alike at every size
    whole = texts.join(places, texts.doc_id.eqNullSafe(F.col("at_id")) & (texts.th == F.col("at_th")), "left_semi")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                sets = shingle_sets(b.slice(at, 512).column("text").cast(pa.binary()).to_pylist(), words)
                fp = fingerprints(sets)
                yield pa.record_batch({"fp1": pa.array(fp[0]), "fp2": pa.array(fp[1]), "set": pa.array([s.tobytes() for s in sets], pa.binary())})

    bodies = whole.select("text").mapInArrow(trimmed(shingled), "fp1 long, fp2 long, set binary").dropDuplicates(["fp1", "fp2"])
    bodies = bodies.join(wanted.select("fp1", "fp2", "rep", "copies", "labels"), ["fp1", "fp2"])
    members = met.join(bodies, "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, TILE):
            at = bounds(table, TILE)
            total = np.zeros(BINS, dtype=np.int64)
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a > 1:
                    out = _tile(table.slice(int(a), int(b - a)), trees, threshold, depth, longer, total)
                    if out is not None:
                        yield out
            some = np.flatnonzero(total)
            nothing = pa.nulls(len(some), pa.int64())
            yield pa.record_batch({"rep": nothing, "links": pa.array(total[some]), "root": nothing, "bin": pa.array(some.astype(np.int32))})

    out = staged(spread(members.select(*TILE, "side", "rep", "copies", "labels", "set"), TILE, compare, "rep long, links long, root long, bin int"), "near-links")
    discard(crowded, met)
    return out


def _shared(x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
    """Whether labels (n, 2) and (m, 2) of one tree share a prefix of depth values: (n, m)."""
    hi, lo = masks(depth)
    out = (x[:, 0] & hi)[:, None] == (y[:, 0] & hi)[None, :]
    return out & ((x[:, 1] & lo)[:, None] == (y[:, 1] & lo)[None, :]) if lo else out


def _unmet(x: np.ndarray, y: np.ndarray, tree: int, depth: int, longer: int | None) -> np.ndarray:
    """Pairs of labels (n, trees, 2) and (m, trees, 2) that no earlier tree, and no longer prefix, has brought."""
    out = np.ones((len(x), len(y)), dtype=bool)
    for k in range(tree):
        out &= ~_shared(x[:, k], y[:, k], depth)
    if longer is not None:
        for k in range(tree, x.shape[1]):  # in the trees before, a longer prefix in common is a shorter one too
            out &= ~_shared(x[:, k], y[:, k], longer)
    return out


def _label_rows(t: pa.Table, trees: int) -> np.ndarray:
    return t.column("labels").combine_chunks().flatten().to_numpy().reshape(t.num_rows, trees, 2)


def _candidates(t: pa.Table, trees: int, threshold: float, depth: int, longer: int | None) -> np.ndarray:
    """Rows of a tile with a partner in it that could be similar enough and that was not met before."""
    side, size = t.column("side").to_numpy(), t.column("shingles").to_numpy()
    rows, cols = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    labels, tree = _label_rows(t, trees), t.column("tree")[0].as_py()
    out = np.zeros(len(side), dtype=bool)
    for a in range(0, len(rows), 512):
        r = rows[a : a + 512]
        x, y = size[r][:, None], size[cols][None, :]
        pair = (np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-9) & (r[:, None] != cols[None, :])
        pair &= _unmet(labels[r], labels[cols], tree, depth, longer)
        out[r] |= pair.any(axis=1)
        out[cols] |= pair.any(axis=0)
    return np.flatnonzero(out)


def _tile(t: pa.Table, trees: int, threshold: float, depth: int, longer: int | None, bins: np.ndarray) -> pa.RecordBatch | None:
    """Links inside one tile that were not met before: of its row block with its column block, or itself.

    The similarities of the pairs are counted in bins.
    """
    rep, copies, side = (t.column(k).to_numpy() for k in ("rep", "copies", "side"))
    rows, cols = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(rows) or not len(cols):
        return None
    labels, tree = _label_rows(t, trees), t.column("tree")[0].as_py()
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("set")]
    size = np.asarray([len(s) for s in sets], dtype=np.int64)
    fresh = _unmet(labels[rows], labels[cols], tree, depth, longer)
    if (side == 2).any():
        fresh &= rows[:, None] < cols[None, :]
    low, high = np.minimum(size[rows][:, None], size[cols][None, :]), np.maximum(size[rows][:, None], size[cols][None, :])
    fresh &= low >= threshold * high - 1e-9
    if not fresh.any():
        return None
    if fresh.sum() <= 32:
        inter = np.zeros(fresh.shape, dtype=np.int64)
        for i, j in zip(*np.nonzero(fresh), strict=True):
            x, y = sets[rows[i]], sets[cols[j]]
            inter[i, j] = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    else:
        inter = _intersections(sets, rows, cols)
    union = low + high - inter
    hit = fresh & (inter >= threshold * union - 1e-9)
    if not hit.any():
        return None
    similar = (inter[hit] / union[hit] - threshold) / max(1e-9, 1 - threshold)
    np.add.at(bins, np.clip((similar * BINS).astype(np.int64), 0, BINS - 1), 1)
    total, forest = np.zeros(len(rep), dtype=np.int64), Forest(len(rep))
    total[rows] += hit @ copies[cols]
    total[cols] += hit.T @ copies[rows]
    for q in np.flatnonzero(hit.any(axis=1)):
        for o in {forest.find(int(c)) for c in cols[hit[q]]}:
            forest.join(int(rows[q]), o)
    linked = np.flatnonzero(total)
    return pa.record_batch({"rep": pa.array(rep[linked]), "links": pa.array(total[linked]), "root": pa.array(rep[[forest.find(int(k)) for k in linked]]), "bin": pa.nulls(len(linked), pa.int32())})


def _intersections(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of row sets with column sets, summed over ranges of the hashes."""
    out = np.zeros((len(rows), len(cols)), dtype=np.float32)
    parts = -(-sum(len(s) for s in sets) // AT_ONCE)
    edges = np.asarray([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]) for s in sets]
    for k in range(parts):
        some = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        if any(map(len, some)):
            _intersect(some, rows, cols, out)
    return np.rint(out).astype(np.int64)


def _intersect(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, out: np.ndarray) -> None:
    """Add the sizes of the intersections to out, by products of 0/1 matrices."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.argsort(flat, kind="stable")
    flat, owner = flat[at], owner[at]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1  # a shingle of one set is in no intersection
    own = often[column]
    column, owner = (np.cumsum(often) - 1)[column[own]], owner[own]
    width = int(often.sum())
    for a in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        x = np.zeros((len(sets), min(4096, width - a)), dtype=np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        out += x[rows] @ x[cols].T


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the rows of the smallest id of each class of linked rows; texts without words all stay.

    Rows that repeat that id all stay, whatever their texts (drop exact copies first); of rows with a null
    id, those stay that are linked with no row that has one. Other columns may have any names.
    """
    kept = link(docs, key=key, text=text, **options).filter("kept").select(F.col("doc_id").alias("keep")).distinct()
    names, at = docs.columns, docs.columns.index
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return rows.join(kept, rows[f"c{at(key)}"].cast("long").eqNullSafe(kept["keep"]), "left_semi").toDF(*names)
