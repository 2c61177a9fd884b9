"""Exact n-gram Jaccard join by count vectors in R-trees.

A document is the set of its distinct word n-grams, hashed to 64 bits. Two documents link when
their Jaccard similarity reaches num/den. The shingles of a set are hashed into groups, and
the counts of the groups are the set's point. The sum of coordinate minima of two points bounds the
overlap of their sets; with the upper corner of an R-tree node it bounds the overlap with every set
below the node. Candidates are what the tree finds by this bound, and only they are verified. Long
sets have more groups, as the bound tells little where a group holds many shingles; sets of several
lengths are compared by the groups of the shortest, into which those of the longer ones are added up.

Points are dealt to trees in two ways, both exact at every threshold:

Buckets. Shingles are ordered by how often they occur in the corpus, rarest first. Of two sets that
link, each holds the other's overlap, so the first n - ceil(n num/den) + 1 shingles of each have
one in common. Distinct sets (copies are one) send these shingles. Those that no other set sends
are dropped, and of shingles that the same sets send one is enough (as a rule a passage has many);
sender lists are told apart by count, smallest sender and a 64-bit hash. The points of each
remaining shingle are searched through a tree. Pairs that pass
the bound tie sets into clusters, which no link leaves. As common shingles come last, a passage that
a third of all documents hold opens a bucket only where a document has hardly anything else; such
shingles tie all their sets by partial aggregation, without a bucket.

Clusters. The texts of a cluster are sent once. A tree over its points names the candidates, and
their sets are intersected, unless links found before connect the pair already. Clusters too large
for a task are cut into blocks that share pivots, and what the pivots do not connect is compared
with all blocks, so that no link between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _batches, _components, _lineage

CACHE_WORDS = 300_000
#: Groups of a set of at most GROUPS * FILL shingles; longer sets have 4, 16, ... times as many.
GROUPS, FILL = 64, 16
#: Entries of an R-tree node.
NODE = 16
#: Counters of the shingle frequencies (a power of two), and those in one row of the aggregation.
COUNTERS, CHUNK = 1 << 20, 4096
#: Sets of a shingle that are searched in one task; more are tied without a search.
BUCKET = 2_000
#: At most so many frequent shingles are broadcast, 24 bytes each; more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000
#: Coordinates that a search looks at together.
CELLS = 4_000_000
#: Shingles that a task holds at once; larger clusters are split.
BLOCK_SHINGLES = 1_500_000
PIVOTS = 8

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct n-gram hashes of texts: A-Z lower-cased, words between ASCII white space."""

    def __init__(self, ngram: int):
        self.ngram, self.known = ngram, _Words()

    def _fold(self, h: np.ndarray, n: int) -> np.ndarray:
        s = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for k in range(n):
            s = _mix(s * _M1 + h[k : k + len(s)])
        return s

    def sets(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        words = [b.lower().split() for b in raws]  # bytes: only A-Z are lowered, only ASCII space splits
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        h = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
        folded = self._fold(h, self.ngram)
        ends = np.cumsum(sizes)
        for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            if start == end:
                yield h[:0]
                continue
            s = folded[start : end - self.ngram + 1] if end - start >= self.ngram else self._fold(h[start:end], end - start)
            s = np.sort(s)
            yield s[np.append(True, s[1:] != s[:-1])]


def _counted(ngram: int):
    """How many sets hold the shingles of each counter, one binary row for CHUNK counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total = Shingler(ngram), np.zeros(COUNTERS, np.int64)
        for batch in _batches.slices(batches):
            sets = list(shingler.sets(_batches.raw(batch, "text")))
            if sets:
                total += np.bincount(_counter(np.concatenate(sets)), minlength=COUNTERS)
        rows = [(k, part.astype("<u4" if part.max() > 0xFFFF else "<u2" if part.max() > 0xFF else "u1")) for k, part in enumerate(total.reshape(-1, CHUNK)) if part.any()]
        yield pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([x.tobytes() for _, x in rows], pa.binary())], names=["chunk", "counts"])

    return run


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def _unpacked(packed: bytes, length: int) -> np.ndarray:
    return np.frombuffer(packed, {1: "u1", 2: "<u2", 4: "<u4"}[len(packed) // length])


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for packed in pdf["counts"]:
        total += _unpacked(packed, CHUNK)
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()]})


def frequencies(rows: DataFrame, ngram: int) -> np.ndarray:
    """Counts of all shingles of all rows in COUNTERS counters; this fixed size is what the driver gets."""
    spec = "chunk int, counts binary"
    total = np.zeros((COUNTERS // CHUNK, CHUNK), np.uint32)
    for r in rows.select("text").mapInArrow(_counted(ngram), spec).groupBy("chunk").applyInPandas(_summed, spec).toLocalIterator():
        total[r["chunk"]] = _unpacked(bytes(r["counts"]), CHUNK)
    return total.ravel()


def prefix(s: np.ndarray, frequency: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest shingles of a set, of which it shares at least one with every set that it links with."""
    n = len(s) + (-num * len(s) // den) + 1
    return s[np.argsort(frequency[_counter(s)], kind="stable")[:n]]


def length_class(sizes: np.ndarray) -> np.ndarray:
    """0 for sets of at most GROUPS * FILL shingles, 1 up to four times as many, and so on."""
    return np.searchsorted(GROUPS * FILL * 4 ** np.arange(20), sizes)


def point(s: np.ndarray) -> bytes:
    """Counts of a set's groups, packed in one, two or four bytes each."""
    groups = GROUPS * 4 ** int(length_class(np.array(len(s))))
    counts = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    top = counts.max()
    return counts.astype("<u4" if top > 0xFFFF else "<u2" if top > 0xFF else "u1").tobytes()


def _points(packed: list[bytes], classes: np.ndarray, to: int) -> np.ndarray:
    """Counts in the groups of class `to`, at most the class of each."""
    groups = GROUPS * 4**to
    if not classes.any() and all(len(p) == groups for p in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(-1, groups).astype(np.int32)
    return np.array([_unpacked(p, GROUPS * 4 ** int(c)).astype(np.int32).reshape(-1, groups).sum(0) for p, c in zip(packed, classes, strict=True)], np.int32)


def _describe(ngram: int, num: int, den: int, frequency: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(ngram)
        for batch in _batches.slices(batches):
            sizes, keys, sent, points = [], [], [], []
            for s in shingler.sets(_batches.raw(batch, "text")):
                some = len(s) > 0
                sizes.append(len(s))
                keys.append(xxhash.xxh3_64_intdigest(s.tobytes()) if some else 0)
                sent.append(prefix(s, frequency, num, den).view(np.int64) if some else None)
                points.append(point(s) if some else None)
            ids = pa.array(np.array(keys, np.uint64).view(np.int64), mask=np.array(sizes) == 0)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), ids, pa.array(sent, pa.list_(pa.int64())), pa.array(points, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "set_id", "prefix", "point"],
            )

    return run


class RTree:
    """An R-tree over count vectors: NODE entries a node, each with the upper corner and the range of set sizes below it."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.order = self._tiles(counts, sizes)
        corner, least, most = counts[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(corner, least, most)]
        while len(corner) > NODE:
            at = np.arange(0, len(corner), NODE)
            corner, least, most = np.maximum.reduceat(corner, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((corner, least, most))

    @staticmethod
    def _tiles(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows in the order of the leaves: parts are halved by size first, then along their widest coordinate."""
        parts, done = [np.argsort(sizes, kind="stable")], []
        while parts:
            part = parts.pop()
            if len(part) <= NODE:
                done.append(part)
                continue
            if sizes[part[-1]] < 2 * sizes[part[0]] or not np.all(np.diff(sizes[part]) >= 0):
                part = part[np.argsort(counts[part, counts[part].var(0).argmax()], kind="stable")]
            half = -(-len(part) // (2 * NODE)) * NODE
            parts += [part[half:], part[:half]]
        return np.concatenate(done)

    def search(self, counts: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all pairs whose overlap can reach the threshold by the sum of coordinate minima."""
        top = len(self.levels[-1][0])
        query, entry = np.repeat(np.arange(len(sizes)), top), np.tile(np.arange(top), len(sizes))
        for level in range(len(self.levels) - 1, -1, -1):
            corner, least, most = self.levels[level]
            n = sizes[query]
            fits = (den * most[entry] >= num * n) & (den * n >= num * least[entry])
            query, entry = query[fits], entry[fits]
            # J >= num/den is (num + den) * overlap >= num * (a + b)
            fits = (num + den) * np.minimum(corner[entry], counts[query]).sum(1, dtype=np.int64) >= num * (sizes[query] + least[entry])
            query, entry = query[fits], entry[fits]
            if level:
                entry = (entry[:, None] * NODE + np.arange(NODE)).ravel()
                query = np.repeat(query, NODE)
                below = entry < len(self.levels[level - 1][0])
                query, entry = query[below], entry[below]
        return query, self.order[entry]


def connect(packed: list[bytes], sizes: np.ndarray, num: int, den: int, verify: Callable[[int, np.ndarray], np.ndarray] | None = None, probes: np.ndarray | None = None) -> np.ndarray:
    """A label per point, equal for those that pairs connect; with `probes` (a mask), only their pairs are sought.

    Pairs are those of the trees, or of these the ones that `verify` (row, others -> linked) confirms.
    There is a tree for each class of lengths, with the longer sets that can link with one of the class.
    """
    label, classes = np.arange(len(sizes)), length_class(sizes)
    for c in np.unique(classes).tolist():
        part = np.flatnonzero((classes == c) | ((classes > c) & (num * sizes <= den * GROUPS * FILL * 4**c)))
        counts, n = _points([packed[i] for i in part], classes[part], c), sizes[part]
        tree, at, step = RTree(counts, n), 0, 1
        asked = np.arange(len(part)) if probes is None else np.flatnonzero(probes[part])
        most = max(1, CELLS // counts.size)
        while at < len(asked) and not (label[part] == label[part[0]]).all():
            rows = asked[at : at + step]
            query, found = tree.search(counts[rows], n[rows], num, den)
            for k in np.unique(query).tolist():
                i, others = part[rows[k]], part[found[query == k]]
                others = others[label[others] != label[i]]
                if len(others) and verify is not None:
                    others = others[verify(i, others)]
                if len(others):
                    label[np.isin(label, label[others])] = label[i]
            at, step = at + step, min(most, 2 * step)
    return label


def linked(sets: list[np.ndarray], num: int, den: int, probes: np.ndarray | None = None) -> np.ndarray:
    """A label per set, equal for sets that links connect; with `probes` (a mask), only their links are sought."""
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.append(0, np.cumsum(sizes))

    def verify(i: int, rows: np.ndarray) -> np.ndarray:
        pick = np.concatenate([flat[starts[j] : starts[j + 1]] for j in rows])
        at = np.minimum(np.searchsorted(sets[i], pick), len(sets[i]) - 1)
        shared = np.add.reduceat(sets[i][at] == pick, np.append(0, np.cumsum(sizes[rows])[:-1]), dtype=np.int64)
        return (num + den) * shared >= num * (sizes[i] + sizes[rows])

    return connect([point(s) for s in sets], sizes, num, den, verify, probes)


def _bounds(key: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys start, and the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def _tied(num: int, den: int):
    """Pairs (a, b) that tie the sets of each shingle by the bound; the rows come sorted by shingle."""

    def edges(token: np.ndarray, ids: np.ndarray, n: np.ndarray, packed: list[bytes]) -> pa.RecordBatch:
        at, classes = _bounds(token), length_class(n)
        first = np.repeat(at[:-1], np.diff(at))
        # All short sets are compared with the first of their shingle at once.
        short = np.maximum.reduceat(classes, at[:-1]) == 0
        rows = np.flatnonzero(np.repeat(short, np.diff(at)))
        counts = np.zeros((len(n), GROUPS), np.int32)
        counts[rows] = _points([packed[i] for i in rows], classes[rows], 0)
        fits = (num + den) * np.minimum(counts, counts[first]).sum(1, dtype=np.int64) >= num * (n + n[first])
        a, b = [ids[first[fits]]], [ids[fits]]
        failed = np.add.reduceat(~fits, at[:-1])
        for k in np.flatnonzero((failed > 0) & ((np.diff(at) > 2) | ~short)).tolist():
            start, end = at[k : k + 2].tolist()
            label = connect(packed[start:end], n[start:end], num, den)
            a.append(ids[start:end][label])
            b.append(ids[start:end])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if rest is None else pa.concat_tables([rest, part])
            token = part.column("token").to_numpy()
            whole = int(_bounds(token)[-2]) if len(token) else 0  # the last shingle may go on in the next batch
            if whole:
                yield edges(token[:whole], part.column("set_id").to_numpy()[:whole], part.column("n").to_numpy()[:whole], part.column("point").slice(0, whole).to_pylist())
            rest = part.slice(whole)
        if rest is not None and rest.num_rows:
            yield edges(rest.column("token").to_numpy(), rest.column("set_id").to_numpy(), rest.column("n").to_numpy(), rest.column("point").to_pylist())

    return run


def _linker(ngram: int, num: int, den: int):
    """Links (a, b) of the clusters of a group of rows; rows that probe are compared with all, else all with all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cluster", "probe", "set_id"], ascending=[True, False, True]).drop_duplicates(["cluster", "set_id"])
        cluster, names, probe = (pdf[c].to_numpy() for c in ("cluster", "least", "probe"))
        shingler, texts, at = Shingler(ngram), pdf["text"].to_numpy(), _bounds(cluster)
        a, b = [], []
        for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            sets = list(shingler.sets([t.encode("utf-8", "surrogatepass") for t in texts[start:end]]))
            probes = probe[start:end].astype(bool)
            label = linked(sets, num, den, probes if probes.any() else None)
            a.append(names[start:end])
            b.append(names[start:end][label])
        links = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
        return links[links["a"] != links["b"]]

    return run


def _compare(rows: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    return rows.groupBy("task").applyInPandas(_linker(ngram, num, den), "a bigint, b bigint")


def _clusters(nodes: DataFrame, num: int, den: int, bucket: int) -> DataFrame:
    """node, root of the sets that the bound ties to another one."""
    sent = nodes.select("set_id", F.explode("prefix").alias("token"))
    stats = sent.groupBy("token").agg(F.count("*").alias("m"), F.min("set_id").alias("first"), F.bit_xor(F.xxhash64("set_id")).alias("senders")).filter("m > 1")
    stats = _lineage.table(stats.groupBy("m", "first", "senders").agg(F.min("token").alias("token")))
    heavy = _lineage.cut(stats.filter(F.col("m") > bucket).select("token", "first"))
    few = heavy.count() <= BROADCAST_SHINGLES
    side = F.broadcast(heavy) if few else heavy
    star = sent.join(side, "token").select(F.col("set_id").alias("a"), F.col("first").alias("b"))
    light = sent.join(F.broadcast(heavy.select("token")), "token", "left_anti") if few else sent
    light = light.join(stats.filter(F.col("m") <= bucket).select("token"), "token")
    light = light.join(nodes.select("set_id", "n", "point"), "set_id").select("token", "set_id", "n", "point")
    tied = light.repartition("token").sortWithinPartitions("token").mapInArrow(_tied(num, den), "a bigint, b bigint")
    return _components.components(tied.union(star))


def components(docs: DataFrame, ngram: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    component_id is the smallest id reachable by links, itself included. A text of fewer words than
    `ngram` is one shingle; null, empty and blank texts have none and are linked with nothing. Rows
    with one id are one document. A row with a null id takes no part in linking; it gets the
    component of the documents that have exactly its set, else null. Other columns are not read.
    Shingles and sets are told apart by 64-bit hashes.
    """
    if not 0 < num <= den:
        raise ValueError(f"a similarity of {num}/{den}")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    frequency = frequencies(rows, ngram)
    base = _lineage.table(rows.mapInArrow(_describe(ngram, num, den, frequency), "doc_id bigint, text_hash bigint, n_shingles bigint, set_id bigint, prefix array<bigint>, point binary"))

    # Equal sets are one node; its name in links is its smallest document.
    own = base.filter("doc_id is not null and set_id is not null").groupBy("set_id")
    nodes = own.agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"), F.first("point").alias("point"))
    nodes = _lineage.table(nodes.select("set_id", F.col("of.doc_id").alias("least"), "of.text_hash", "copies", "n", "prefix", "point"))
    clusters = _clusters(nodes, num, den, bucket).select(F.col("node").alias("set_id"), F.col("root").alias("cluster"))
    members = _lineage.cut(nodes.select("set_id", "least", "text_hash", "n").join(clusters, "set_id"))
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("weight"))
    large = _lineage.cut(sizes.filter(F.col("weight") > block_shingles).withColumn("blocks", F.ceil(F.col("weight") / (block_shingles / 2))))
    total = members.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-int(total) // block_shingles), 2 * int(docs.sparkSession.sparkContext.defaultParallelism))

    # The text of each member is that of its smallest document.
    full = rows.withColumnRenamed("doc_id", "least").join(members, ["least", "text_hash"])
    small = F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("task")
    if large.isEmpty():
        links = _compare(full.select("cluster", "set_id", "least", "text", F.lit(False).alias("probe"), small), ngram, num, den)
    else:
        full = _lineage.table(full.join(large.select("cluster", "blocks"), "cluster", "left"))
        links = _compare(full.filter("blocks is null").select("cluster", "set_id", "least", "text", F.lit(False).alias("probe"), small), ngram, num, den)
        links = links.union(_large(full.filter("blocks is not null"), ngram, num, den, block_shingles))
    roots = _components.components(links)

    named = nodes.select("set_id", "least", "copies").join(roots.withColumnRenamed("node", "least"), "least", "left")
    named = _lineage.table(named.select("set_id", "copies", F.coalesce("root", "least").alias("component")))
    out = _components.looked_up(base.select("doc_id", "n_shingles", "set_id"), "set_id", named, "component", "copies")
    # Rows of one id with different sets are one document.
    ids = out.groupBy("doc_id").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter("c <> d and doc_id is not null")
    if not ids.isEmpty():
        merged = _components.components(ids.select(F.col("c").alias("a"), F.col("d").alias("b")).union(out.filter("doc_id is not null and component is not null").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))))
        out = out.join(merged.select(F.col("node").alias("component"), F.col("root")), "component", "left").withColumn("component", F.coalesce("root", "component"))
    return out.select("doc_id", "n_shingles", F.coalesce("component", F.when(F.col("set_id").isNull(), F.col("doc_id"))).alias("component_id"))


def _large(full: DataFrame, ngram: int, num: int, den: int, block_shingles: int) -> DataFrame:
    """Links of clusters that no task can hold.

    First every block is joined inside itself and with the pivots of its cluster. Then what is not
    in the largest component of its cluster is compared, in chunks, with every block; pairs inside
    that component need no look, as it is connected.
    """
    spread = F.xxhash64("set_id")
    full = full.select("cluster", "set_id", "least", "text", "n", "blocks").withColumn("block", F.pmod(spread, F.col("blocks")))
    row = [F.col(c) for c in ("cluster", "set_id", "least", "text")]
    chosen = full.groupBy("cluster", F.pmod(F.xxhash64(spread), F.lit(PIVOTS)).alias("nth")).agg(F.min("set_id").alias("set_id"))
    pivot = full.join(chosen.select("cluster", "set_id"), ["cluster", "set_id"])
    pivot = pivot.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = full.select(*row, "block").union(pivot.select(*row, "block"))
    first = _lineage.cut(_compare(rows.select(*row, F.lit(False).alias("probe"), F.xxhash64("cluster", "block").alias("task")), ngram, num, den))
    labels = full.select("cluster", "set_id", "least").join(_components.components(first).withColumnRenamed("node", "least"), "least", "left").withColumn("root", F.coalesce("root", "least"))
    count = labels.groupBy("cluster", "root").count()
    core = count.groupBy("cluster").agg(F.max_by("root", F.struct("count", "root")).alias("core"))
    rest = _lineage.cut(labels.join(core, "cluster").filter("root <> core").select("set_id"))
    if rest.isEmpty():
        return first
    probes = _lineage.cut(full.join(rest, "set_id"))
    chunks = probes.groupBy("cluster").agg(F.ceil(F.sum("n") / (block_shingles / 2)).alias("chunks"))
    probes = probes.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64(spread), F.col("chunks")))
    asked = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*row, "block", "chunk", F.lit(True).alias("probe"))
    told = full.join(chunks, "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*row, "block", "chunk", F.lit(False).alias("probe"))
    second = _compare(asked.union(told).select(*row, "probe", F.xxhash64("cluster", "block", "chunk").alias("task")), ngram, num, den)
    return first.union(second)
