"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius through BK-trees."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, give_back


def shingle_hashes(text: bytes, words_per_shingle: int) -> np.ndarray:
    """Hashes of a whole text's shingles, repeats included; fewer words are one shingle, no words none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: lower-cases A-Z and splits at ASCII white space only
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return np.array([xxh64_intdigest(joined, 42)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-words_per_shingle])).tolist()
    ends = (ends[words_per_shingle - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """SimHash: a bit is 1 if it is set in over half the hashes; none give 0."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        bits = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words_per_shingle: int = 4) -> int:
    """SimHash of a whole text; no words give 0."""
    return majority(shingle_hashes(text, words_per_shingle))


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp): fp is the fingerprint's 64 bits as a signed long. A null text is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"", words_per_shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


class BKTree:
    """Children are keyed by their distance to the parent; a search follows only edges within the radius."""

    def __init__(self):
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        items, children = self.items, self.children
        if items:
            i = 0
            while d := (x ^ items[i]).bit_count():
                j = children[i].get(d)
                if j is None:
                    children[i][d] = len(items)
                    break
                i = j
            else:
                return  # it is there already
        items.append(x)
        children.append({})

    def within(self, x: int, radius: int) -> list[int]:
        """Numbers of all items at `radius` or fewer differing bits from x."""
        items, children, found, stack = self.items, self.children, [], [0] if self.items else []
        while stack:
            i = stack.pop()
            d = (x ^ items[i]).bit_count()
            if d <= radius:
                found.append(i)
            if c := children[i]:
                low, high = d - radius, d + radius
                stack += [j for e, j in c.items() if low <= e <= high]
        return found


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of which any two fingerprints at `radius` or fewer differing bits agree on at least one: the bits fall into
    `blocks` blocks, of which at least blocks - radius are equal."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    parts = [(1 << int(b)) - (1 << int(a)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_components(fps: DataFrame, radius: int = 4, blocks: int = 6, page: int = 1024) -> DataFrame:
    """fps(fp), distinct -> (node, root): components of fingerprints linked at `radius` or fewer differing bits.

    Fingerprints meet by the bits under each mask (no pair can miss all masks). What shares a mask's bits is dealt into
    pages of about `page` fingerprints, each a BK-tree: see components_in_pages."""
    masks = block_masks(blocks, radius)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.mask", "k.part")
    sizes = keyed.groupBy("mask", "part").count().where("count > 1").select("mask", "part", F.ceil(F.col("count") / page).cast("int").alias("pages"))
    met = keyed.join(sizes, ["mask", "part"]).withColumn("own", F.pmod(F.xxhash64("fp", "mask"), F.col("pages")).cast("int"))
    return components_in_pages(met.select("mask", "part", "pages", "own", F.col("fp").alias("node"), "fp"), None, radius, None)


def components_in_pages(met: DataFrame, sets: DataFrame | None, radius: int, similarity: float | None) -> DataFrame:
    """met(mask, part, pages, own, node, fp), sets(node, shingles) -> (node, root): components of what is linked inside the
    groups of a mask and part, each dealt into pages.

    First each page by itself, then the pages of a group with each other, but only in groups that aren't one component
    yet: a hot group of copies costs as many pages as it has, not their square. A task holds two pages at most."""

    def find(first: list[tuple], second: list[tuple], same: bool) -> list[tuple[int, int]]:
        return linked_in_pages(first, second, same, radius, similarity)

    def item(label: str) -> Column:
        return F.struct("node", "fp", F.col(label).alias("label"), F.lit(None).cast("binary").alias("shingles") if sets is None else F.col("shingles")).alias("item")

    met = cut(met)
    if sets is not None:  # shingles move only of texts that meet another
        sets = sets.join(cut(met.select("node").distinct()), "node", "left_semi")
    carried = lambda rows: rows if sets is None else rows.join(sets, "node")
    inside = carried(met)
    links = cut(paged(inside.select("mask", "part", F.col("own").alias("i"), F.col("own").alias("j"), "own", item("node")), find))
    roots = connected_components(links)
    split = cut(met.where("pages > 1").join(roots, "node", "left").select("mask", "part", "pages", "own", "node", "fp", F.coalesce("root", "node").alias("label")))
    if split.isEmpty():
        return roots
    open_groups = split.groupBy("mask", "part").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("mask", "part")
    across = carried(split.join(open_groups, ["mask", "part"])).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).where("own <> other")
    across = across.select("mask", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", item("label"))
    return connected_components(links.unionByName(paged(across, find)))


def paged(dealt: DataFrame, find: Callable[[list[tuple], list[tuple], bool], list[tuple[int, int]]]) -> DataFrame:
    """dealt(mask, part, i, j, own, item) -> (u, v): what `find` gives for each two pages i and j of a group: the items of
    page i, those of page j, and whether they are one page (the second is empty then). A task holds two pages at most."""
    keys = ["mask", "part", "i", "j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, second, found = None, [], [], []

        def close() -> None:
            if now is not None and len(first) + len(second) > 1:
                found.extend(find(first, second, now[2] == now[3]))

        def flush() -> pa.RecordBatch:
            pairs = np.array(found, np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in (*keys, "own")}
            items = zip(*(x.to_pylist() for x in batch.column("item").flatten()), strict=True)
            for key, own, x in zip(zip(*(c[n] for n in keys), strict=True), c["own"], items, strict=True):
                if key != now:
                    close()
                    now, first, second = key, [], []
                (first if own == key[2] else second).append(x)
            if len(found) > 50_000:
                yield flush()
        close()
        if found:
            yield flush()
        give_back()

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "item").mapInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint, component_id), a row for each row of docs.

    component_id is the smallest doc_id of all documents that links reach. Null and empty texts have fingerprint 0 and
    link like any other; rows of one id and repeated rows are separate rows with their own text's component; null ids
    stay null and never name a component that holds a document with an id. No rows give no rows."""
    docs_fp = cut(fingerprints(docs, words_per_shingle))
    fps = cut(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # more blocks make longer keys: the groups that meet by chance stay small as the corpus grows, and no link is lost
    n = fps.count()
    blocks = radius + (2 if n < 20_000_000 else 3 if n < 500_000_000 else 4)
    roots = fingerprint_components(fps.select("fp"), radius, blocks)
    member = fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = member.where("fp <> root").groupBy("root").agg(F.min("least").alias("lower"))
    known = member.join(least, "root", "left").select("fp", F.least("least", "lower").alias("own"), "root")
    # the root's own row holds the least of the whole component; the others look it up there
    top = known.where("fp = root").select(F.col("root").alias("top"), F.col("own").alias("component_id"))
    named = known.join(top, F.col("root") == F.col("top")).select("fp", "component_id")
    return docs_fp.join(named, "fp").select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


#: Bands of KEYS of the least hashes of the shingles under random functions: two texts of similarity J agree on a band
#: with probability J ** KEYS, and on one of BANDS at 0.8 with 0.994.
BANDS, KEYS = 5, 2
#: At a similarity of 0.8 fingerprints differ in 10 bits on the mean, with a deviation of 3; within RADIUS texts are
#: compared. Pages hold about PAGE texts, or PAGE_SHINGLES shingles if that is less.
RADIUS, PAGE, PAGE_SHINGLES = 18, 1024, 4 << 20
FLIPS, FACTORS = np.random.default_rng(23).integers(1 << 63, size=(2, BANDS * KEYS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """The keys of the bands of a text, as signed longs; that of no shingles is 0 in each."""
    if not len(hashes):
        return [0] * BANDS
    parts = [((hashes[None, a : a + 8192] ^ FLIPS) * FACTORS).min(axis=1) for a in range(0, len(hashes), 8192)]
    mixed = (np.min(parts, axis=0).reshape(BANDS, KEYS) * FACTORS[:KEYS, 0]).sum(axis=1)
    return mixed.view(np.int64).tolist()


def signatures(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """docs(uid, doc_id, text) -> (uid, doc_id, same, fp, keys, n, shingles): a hash of the words, the SimHash, the
    bands, and the n different shingles as sorted 32-bit hashes."""
    from hashlib import md5

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, fps, keys, sets = [], [], [], []
            for t in batch.column(2):
                text = t.as_py() or b""
                hashes = shingle_hashes(text, words_per_shingle)
                same.append(md5(b" ".join(text.lower().split())).digest())
                fps.append(_signed(majority(hashes)))
                keys.append(band_keys(hashes))
                sets.append(np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array([len(x) // 4 for x in sets], pa.int64()), pa.array(sets, pa.binary())],
                names=["uid", "doc_id", "same", "fp", "keys", "n", "shingles"],
            )
        give_back()

    return docs.select("uid", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"uid long, doc_id {kind}, same binary, fp long, keys array<long>, n long, shingles binary")


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least `similarity` of what either has in common."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= similarity * (len(x) + len(y) - common)


def linked_in_pages(first: list[tuple], second: list[tuple], same: bool, radius: int, similarity: float | None) -> list[tuple[int, int]]:
    """Links that connect all items of a page, or of two, whose fingerprints lie within the radius and that share
    `similarity` of their shingles (None: these aren't asked for). Items are (node, fp, label, shingles); those of one
    label are connected already, and so is what a link has connected: only items that aren't are compared."""
    if not first:
        return []
    up, sets, out = {}, {}, []
    # between pages, the most frequent label has a tree of its own, which texts of that label needn't search
    common_label = None if same else Counter(item[2] for item in first).most_common(1)[0][0]
    trees = {own: (BKTree(), {}) for own in (True, False)}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def shingles(node: int, raw: bytes) -> np.ndarray:
        if node not in sets:
            sets[node] = np.frombuffer(raw, np.uint32)
        return sets[node]

    def meet(item: tuple) -> None:
        node, fp, label, raw = item
        mine = root(label)
        for own, (tree, at_fp) in trees.items():
            if own and label == common_label:
                continue
            for i in tree.within(fp & (1 << 64) - 1, radius):
                for other, other_label, other_raw in at_fp[tree.items[i]]:
                    if (theirs := root(other_label)) == mine:
                        continue
                    if similarity is None or similar(shingles(node, raw), shingles(other, other_raw), similarity):
                        out.append((node, other))
                        up[mine] = mine = theirs

    def add(item: tuple) -> None:
        node, fp, label, raw = item
        tree, at_fp = trees[label == common_label]
        tree.add(fp & (1 << 64) - 1)
        at_fp.setdefault(fp & (1 << 64) - 1, []).append((node, label, raw))

    for item in first:
        if same:
            meet(item)
        add(item)
    for item in second:
        meet(item)
    return out


def near_components(contents: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """contents(node, fp, keys, n), sets(node, shingles) -> (node, root): components of different texts that are linked by a
    similarity (Jaccard, of the sets of shingles) of `similarity` or more.

    Texts that agree on a band meet in pages; what lies within RADIUS is compared."""
    keyed = contents.select("node", "fp", "n", F.posexplode("keys").alias("mask", "part"))
    pages = F.ceil(F.greatest(F.count(F.lit(1)) / PAGE, F.sum("n") / PAGE_SHINGLES)).cast("int")
    sizes = keyed.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("texts"), pages.alias("pages")).where("texts > 1").drop("texts")
    # a page's number differs by band: a group that meets in all of them is dealt in another way in each
    met = keyed.join(sizes, ["mask", "part"]).withColumn("own", F.pmod(F.xxhash64("node", "mask"), F.col("pages")).cast("int"))
    return components_in_pages(met.select("mask", "part", "pages", "own", "node", "fp"), sets, RADIUS, similarity)


def keep_one(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates: texts that share `similarity` of their shingles or more are
    linked, directly or over others. The row of the smallest doc_id stays, rows without an id last, ties by their place
    in docs. All columns stay as they are; rows are told apart by themselves, never by doc_id. Texts of the same words
    are copies; null texts and texts without words are copies of each other. No rows give no rows."""
    names = docs.columns
    uid = next(n for n in (f"__uid{i}" for i in range(len(names) + 1)) if n not in names)
    rows = cut(docs.withColumn(uid, F.monotonically_increasing_id()))
    signed = cut(signatures(rows.select(F.col(uid).alias("uid"), "doc_id", "text"), words_per_shingle))
    copies = cut(signed.groupBy("same").agg(F.min("uid").alias("node")))
    named = signed.withColumnRenamed("uid", "node")
    contents = named.select("node", "fp", "keys", "n").join(copies.select("node"), "node", "left_semi")
    roots = near_components(contents, named.select("node", "shingles"), similarity)
    group = copies.select("same", "node").join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("group"))
    placed = cut(signed.join(group, "same").select("uid", "doc_id", "group"))
    first = placed.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first"), F.count(F.lit(1)).alias("n"))
    gone = cut(placed.join(first.where("n > 1"), "group").where("uid <> first.uid").select(F.col("uid").alias(uid)))
    return rows.join(gone, uid, "left_anti").select(*names)
