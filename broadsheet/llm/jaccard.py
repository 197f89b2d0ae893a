"""N-gram Jaccard join with signature trees, down to linked components.

Two documents link when the Jaccard similarity of their sets of distinct word shingles is at least num / den. All links
between different sets are found; a group of similar documents is never expanded into all its pairs.

1. Sets are reduced to classes: (size, two 64-bit sums) names a set, so exact copies count once from here on.
2. Coverage filter. With hashes in one global order, the first |x| - a + l hashes of x (a = least overlap, l = 0.15 |x|)
   share l of them with those of every partner. A packed exchange counts which are held by another class; classes with
   too few cannot have a partner. In usual corpora few classes are left, and only their sets travel.
3. Groups by the least hash under three salts, in blocks of at most ``BLOCK`` sets: a signature tree per block, a dual
   traversal, an exact check, and a union-find that leaves pairs already connected. This links most of what is similar.
4. Completion. A linked pair shares a hash among the first |x| - a + 1 of either set, in an order that puts hashes with
   many holders last. A hash whose holders lie in more than one component sends them all to its host, the largest of
   these components. The sets that meet at a host (in pairs of blocks, if many) are joined by a signature tree again,
   with an exact check, leaving pairs already connected. Since both ends of every link across components meet at a
   host, none is lost; a set travels once per host and block, not once per hash. At a host with more than
   ``HOST_BLOCKS`` blocks only those meet that share a hash: its hashes are dealt into parts of about half a block, and a
   set goes to the parts of its own hashes, so the copies grow with its length and not with the visitors. Only the
   holders of one hash that fill several blocks still meet in pairs of blocks. No task gathers the holders of a very
   frequent hash: what a task can settle by itself does not travel, and the hosts of such hashes, as
   far as they are ranked, are aggregates.

Cases: a document without words or text has an empty set and links with nothing. Fewer words than a shingle make one
shingle of the whole sequence. Ties at exactly the threshold link (integer arithmetic). Rows that repeat an id are one
document with several sets: each row shows the size of its own set, a link of any of them is a link of the document, and
all of them carry its component. A null id is kept, unlinked, and reported with a null component; ids that are not whole
numbers are an error. An empty table gives an empty result. Only the id and the text are read.

Exactness: sets are compared on 48 of the 64 bits of their hashes and named by 128 bits, so results are exact but for hash
collisions (two sets of 1000 differ from their full hashes once in 10**8 pairs). ``MOST_RANKED`` bounds the list that
decides the order of hashes; beyond it the order is poorer, which costs time and changes no result. Only components are
returned: pairs that are connected already are not compared, so a document's number of links is not known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import packed
from broadsheet.operators.components import components
from broadsheet.llm.shared import Scratch, buckets, chunks, long_id, maybe_broadcast, release, small_batches, text_bytes, tidy
from broadsheet.llm.signature_tree import Tree, Union, bitmap, overlap
from broadsheet.llm.words import Words, mix

SHINGLE = 5
NUM, DEN = 3, 4
#: Sets in a block of a group; groups of any size fall into as many blocks as they need.
BLOCK = 512
SALTS = 3
#: Visitors of a host with more blocks than this are dealt by the hashes that lead them there.
HOST_BLOCKS = 64
#: Bytes of a hash in the sets that are compared: two sets of 1000 differ from their full hashes once in 10**8 pairs.
HASH_BYTES = 6
_SPLIT = np.uint64(0x8CB92BA72F3D8DD7)
#: Hashes with at least 2 ** FIRST_LEVEL holders get a rank by the number of holders, as long as at most MOST_RANKED do
#: (the least frequent of them go without, which changes the order but no result).
FIRST_LEVEL = 5
MOST_RANKED = 200_000
#: Ranked hashes with at least 2 ** HOT_LEVEL holders get their hosts before the exchange, which their holders then skip.
HOT_LEVEL = 20


def _least(n: np.ndarray | int, num: int = NUM, den: int = DEN):
    """Least overlap that a set of size n has with any partner."""
    return -(-num * n // den)


def set_class(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    a = mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64)
    b = mix(s ^ np.uint64(0xF00DFACE12345)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _ship(s: np.ndarray) -> bytes:
    """A set as it travels: the leading 48 bits of each hash, in byte planes."""
    return packed.planes(s >> np.uint64(16), HASH_BYTES)


def _unship(raw: bytes | pa.Buffer) -> np.ndarray:
    return packed.unplanes(raw, HASH_BYTES)


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sets = Words(batch.column(1), lower=True).shingle_sets(width)
        names = [set_class(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([c[0] for c in names], pa.int64()), pa.array([c[1] for c in names], pa.int64())],
            names=["id", "n", "c1", "c2"],
        )


def _prefixes(batches: Iterator[pa.RecordBatch], n_buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """The first hashes of each class that the task meets; a class that it meets again is skipped (bounded memory)."""
    seen: set[int] = set()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in chunks(batches):
        for s in Words(batch.column(1), lower=True).shingle_sets(width):
            n = len(s)
            if not n:
                continue
            name = set_class(s)[0]
            if name in seen:
                continue
            if len(seen) >= 500_000:
                seen.clear()
            seen.add(name)
            first = s[: min(n, n - _least(n) + 3 * n // 20 + 1)]
            held.append((first, np.full(len(first), name, np.int64)))
            size += len(first)
        if size >= packed.FLUSH:
            yield from _flush(held, n_buckets)
            held, size = [], 0
    if held:
        yield from _flush(held, n_buckets)


def _flush(held: list[tuple[np.ndarray, np.ndarray]], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """What the task can settle itself stays with it: of a hash that several classes hold here one entry travels, marked
    by its last bit, and each of these classes is sent its number of such hashes (bucket -1 - class bucket)."""
    h, owner = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(h, kind="stable")
    starts = packed.runs(h[order])
    sizes = np.diff(np.append(starts, len(h)))
    both = np.minimum.reduceat(owner[order], starts) != np.maximum.reduceat(owner[order], starts)
    settled, lead = np.zeros(len(h), bool), np.zeros(len(h), bool)
    settled[order] = np.repeat(both, sizes)
    lead[order[starts[both]]] = True
    if settled.any():
        names, counts = np.unique(owner[settled], return_counts=True)
        yield packed.pack((-1 - names % n_buckets).astype(np.int32), names, counts)
    go = lead | ~settled
    h, owner, lead = h[go], owner[go], lead[go].astype(np.uint64)
    bucket = (mix(h ^ _SPLIT) % np.uint64(n_buckets)).astype(np.int32)
    yield packed.pack(bucket, owner, np.zeros(0, np.uint32), mix(h) >> np.uint64(1) << np.uint64(1) | lead)


def _shared(table: pa.Table) -> pa.Table:
    """Per class, how many hashes of this bucket another class holds too. A class that several tasks have sent may count a
    hash once for each of them, which leaves a class too many and never one too few."""
    owner, counts, h, _ = packed.unpack(table)
    if table.column("bucket")[0].as_py() < 0:
        names, at = np.unique(owner, return_inverse=True)
        return pa.table([pa.array(names, pa.int64()), pa.array(np.bincount(at, counts).astype(np.int64))], names=["c1", "shared"])
    order = np.argsort(h, kind="stable")
    told, sh, so = h[order] & np.uint64(1) == 1, h[order] >> np.uint64(1), owner[order]
    starts = packed.runs(sh)
    sizes = np.diff(np.append(starts, len(sh)))
    both = np.minimum.reduceat(so, starts) != np.maximum.reduceat(so, starts)
    mark = np.repeat(both, sizes) & ~told
    pick = np.lexsort((sh[mark], so[mark]))
    o, h = so[mark][pick], sh[mark][pick]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    names, counts = np.unique(o[new], return_counts=True)
    return pa.table([pa.array(names, pa.int64()), pa.array(counts, pa.int64())], names=["c1", "shared"])


def _sets(batches: Iterator[pa.RecordBatch], width: int, salts: int) -> Iterator[pa.RecordBatch]:
    """Sets of the classes that are left, with a group key for each salt."""
    for batch in chunks(batches):
        sets = Words(batch.column(1), lower=True).shingle_sets(width)
        # An empty set comes here only as a further row of an id that has another one.
        filled = pa.array([len(s) > 0 for s in sets], pa.bool_())
        batch, sets = batch.filter(filled), [s for s in sets if len(s)]
        keys = [[int(mix(s ^ np.uint64(977 * (r + 1))).min().view(np.int64)) for r in range(salts)] for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_ship(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["id", "n", "hashes", "keys"],
        )


def _tree(sets: list[np.ndarray], sizes: np.ndarray) -> Tree:
    return Tree(np.stack([bitmap(s) for s in sets]), sizes, np.array([s[0] for s in sets], np.uint64))


def _block_links(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links that connect what is connected inside one block and was not by its labels: (a, b), b the least id."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    label = table.column("label").to_numpy()[order]
    raw = table.column("hashes").to_pylist()
    sets = [_unship(raw[i]) for i in order]
    union = Union(len(ids))
    known: dict[int, int] = {}
    for i, name in enumerate(label.tolist()):
        union.join(i, known.setdefault(name, i))
    roots = [union.find(i) for i in range(len(ids))]
    for left, right in _tree(sets, np.array([len(s) for s in sets])).pairs(num, den):
        for i, j in zip(left.tolist(), right.tolist()):
            if union.find(i) != union.find(j):
                common = overlap(sets[i], sets[j])
                if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                    union.join(i, j)
    root = np.array([union.find(i) for i in range(len(ids))], np.int64)
    # What was connected before needs no link again: one link for each of the components that have been joined.
    off = (root != np.arange(len(ids))) & (np.array(roots) == np.arange(len(ids)))
    return pa.table([pa.array(ids[off]), pa.array(ids[root[off]])], names=["a", "b"])


def _holders(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Number of holders of each hash, combined in the task (``places`` holds the counts)."""
    held, size = [], 0
    for batch in batches:
        for raw in batch.column(0):
            held.append(_unship(raw.as_buffer()))
            size += len(held[-1])
            if size >= packed.FLUSH:
                yield _counted(held, n_buckets)
                held, size = [], 0
    if held:
        yield _counted(held, n_buckets)


def _counted(held: list[np.ndarray], n_buckets: int) -> pa.RecordBatch:
    h, counts = np.unique(np.concatenate(held), return_counts=True)
    return packed.pack((mix(h ^ _SPLIT) % np.uint64(n_buckets)).astype(np.int32), np.zeros(len(h), np.int64), counts, h, width=HASH_BYTES)


def _ranked(table: pa.Table) -> pa.Table:
    _, counts, h, _ = packed.unpack(table, HASH_BYTES)
    order = np.argsort(h, kind="stable")
    h, counts = h[order], counts[order]
    starts = packed.runs(h)
    total = np.add.reduceat(counts, starts)
    level = np.log2(total).astype(np.int32)
    many = level >= FIRST_LEVEL
    return pa.table([pa.array(h[starts][many].view(np.int64)), pa.array(level[many])], names=["token", "level"])


class Order:
    """Global order of hashes: by level, then by value. Hashes that are not listed have level 0."""

    def __init__(self, tokens: np.ndarray, levels: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.levels = np.append(tokens[order], np.uint64(2**64 - 1)), np.append(levels[order], 0)

    def first(self, s: np.ndarray, n: int) -> np.ndarray:
        at = np.searchsorted(self.tokens[:-1], s)
        level = np.where(self.tokens[at] == s, self.levels[at], 0)
        return s[np.argsort(level, kind="stable")[:n]]


class Hosts:
    """Hosts of the hashes that very many documents hold: an open hash leads its holders to its host, the others nowhere."""

    def __init__(self, tokens: np.ndarray, open_tokens: np.ndarray, hosts: np.ndarray):
        self.tokens, self.open, self.host = np.sort(tokens), np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
        at = np.searchsorted(self.tokens, open_tokens)
        self.open[at], self.host[at] = True, hosts

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``tokens`` are listed, and their places in the list."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        listed = self.tokens[at] == tokens
        return listed, at[listed]


def _first_hashes(batches: Iterator[pa.RecordBatch], order: Order) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(id, component, its size, prefix hashes) of each document."""
    for batch in batches:
        for i, label, count, raw in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
            s = _unship(raw.as_buffer())
            yield i, label, min(count, 2**32 - 1), order.first(s, len(s) - _least(len(s)) + 1)


def _candidate_hosts(batches: Iterator[pa.RecordBatch], order: Order, hot: Hosts) -> Iterator[pa.RecordBatch]:
    """Of each listed hash the largest component that the task meets, and the range of the components' labels."""
    n = len(hot.tokens)
    size, best, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    for _, label, count, first in _first_hashes(batches, order):
        _, at = hot.find(first)
        over = at[(count > size[at]) | ((count == size[at]) & (label < best[at]))]
        size[over], best[over] = count, label
        low[at], high[at] = np.minimum(low[at], label), np.maximum(high[at], label)
    met = size > 0
    yield pa.RecordBatch.from_arrays([pa.array(x[met]) for x in (hot.tokens.view(np.int64), size, best, low, high)], names=["token", "size", "label", "low", "high"])


def _hosts(named: DataFrame, order: Order, tokens: np.ndarray) -> Hosts | None:
    """Hosts of ``tokens``, at most ``MOST_RANKED``: aggregated in the tasks first, so that no task gathers the holders."""
    if not len(tokens):
        return None
    hot = Hosts(tokens, tokens[:0], np.zeros(0, np.int64))
    met = named.mapInArrow(lambda it: _candidate_hosts(it, order, hot), "token long, size long, label long, low long, high long")
    # Of components of one size the least label is the host.
    best = F.max(F.struct("size", F.bitwise_not("label").alias("turned"))).alias("best")
    found = met.groupBy("token").agg(best, F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    got = found.select("token", F.bitwise_not("best.turned").alias("host")).toArrow()
    return Hosts(tokens, got.column("token").to_numpy().view(np.uint64), got.column("host").to_numpy())


def _prefix_entries(batches: Iterator[pa.RecordBatch], n_buckets: int, order: Order, hot: Hosts | None) -> Iterator[pa.RecordBatch]:
    """Prefix hashes of each document with its component and the component's size (packed into one number); for hashes
    whose host is known, the visits themselves (bucket -1 - document bucket)."""
    held, known, size = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            owner, tokens, name = (np.concatenate(x) for x in zip(*held))
            yield packed.pack((mix(tokens ^ _SPLIT) % np.uint64(n_buckets)).astype(np.int32), owner, name[:, 1], tokens, name[:, 0].copy().view(np.uint64), 8)
        if known:
            owner, tokens, host = (np.concatenate(x) for x in zip(*known))
            yield packed.pack(-1 - packed.slot(owner, n_buckets), owner, np.zeros(0, np.uint32), tokens, host.view(np.uint64), 8)

    for i, label, count, first in _first_hashes(batches, order):
        size += len(first)
        if hot is not None:
            listed, at = hot.find(first)
            leads = hot.open[at]
            known.append((np.full(leads.sum(), i, np.int64), first[listed][leads], hot.host[at][leads]))
            first = first[~listed]
        held.append((np.full(len(first), i, np.int64), first, np.tile(np.array([label, count], np.int64), (len(first), 1))))
        if size >= packed.FLUSH:
            yield from flush()
            held, known, size = [], [], 0
    if held:
        yield from flush()


def _open(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, host, hash) of the holders of hashes that more than one component holds."""
    owner, count, token, label = packed.unpack(table, 8, 8)
    if table.column("bucket")[0].as_py() < 0:
        return owner, label.view(np.int64), token.view(np.int64)
    label, count = label.view(np.int64), count.astype(np.int64)
    # Of each hash's components the largest comes first, the least label among equals.
    order = np.lexsort((label, -count, token))
    owner, token, label = owner[order], token[order], label[order]
    starts = packed.runs(token)
    sizes = np.diff(np.append(starts, len(token)))
    open_ = np.repeat(np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts), sizes)
    host = np.repeat(label[starts], sizes)
    return owner[open_], host[open_], token[open_].view(np.int64)


def _visits(table: pa.Table) -> pa.Table:
    """Each holder once at each of its hosts."""
    owner, host, _ = _open(table)
    pairs = np.unique(np.stack([owner, host], 1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "host"])


def _hash_visits(table: pa.Table) -> pa.Table:
    """Each holder at its hosts, once for each hash that leads it there."""
    return pa.table([pa.array(x) for x in _open(table)], names=["id", "host", "token"])


def _blocks(rows: DataFrame, key: list[str], most: int, scratch: Scratch, name: str) -> DataFrame:
    """Adds ``parts``: into how many blocks of about ``most`` rows a key with at least two rows falls.

    The counts are written first: as a table of their own they are broadcast if few, and otherwise leave the join free to
    split the rows of a hot key, which it could not above an aggregate.
    """
    counts = rows.groupBy(*key).count().where("count > 1").select(*key, F.ceil(F.col("count") / most).cast("int").alias("parts"))
    counts = scratch.keep(counts, name)
    return rows.join(maybe_broadcast(counts, counts.count()), key)


def _by_hash(hot: DataFrame, visits: DataFrame, entries: Callable[[DataFrame], DataFrame], named: DataFrame, scratch: Scratch) -> DataFrame:
    """Visits (host, part, id) of the hosts ``hot``: a part takes the visitors that come with some of the host's hashes.

    All holders of a hash that leads to a host visit that host, so the entries of the visitors alone give the same hashes
    again; a hash of another host may get a host of its own choice there, and is left out if that is not a hot one.
    """
    ids = scratch.keep(visits.join(hot, "host", "left_semi").select("id").distinct(), "hot-ids")
    chosen = named.join(maybe_broadcast(ids, ids.count()), "id", "left_semi")
    hashed = entries(chosen).groupBy("bucket").applyInArrow(tidy(_hash_visits), "id long, host long, token long")
    hashed = scratch.keep(hashed.join(hot, "host", "left_semi"), "hash-visits")
    # Parts of half a block, so that only the holders of a hash with many of them take more than one block.
    parts = scratch.keep(hashed.groupBy("host").agg(F.ceil(2 * F.count("*") / BLOCK).alias("n_parts")), "hash-parts")
    part = F.pmod(F.xxhash64("token"), "n_parts").cast("int")
    return hashed.join(maybe_broadcast(parts, parts.count()), "host").select("host", part.alias("part"), "id").distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the least id reachable by links, itself included."""
    num, den = NUM, DEN
    spark = docs.sparkSession
    small_batches(spark)
    scratch, n_buckets = Scratch(spark, "jaccard"), buckets(spark, text_bytes(docs, text_col))
    source = docs.select(long_id(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    signed = scratch.keep(source.mapInArrow(lambda it: _signatures(it, width), "id long, n long, c1 long, c2 long"), "signed")
    filled = signed.where("n > 0 and id is not null")
    classes = filled.groupBy("c1", "c2", "n").agg(F.min("id").alias("rep"))

    entries = source.where("id is not null").mapInArrow(lambda it: _prefixes(it, n_buckets, width), packed.SCHEMA)
    shared = entries.groupBy("bucket").applyInArrow(tidy(_shared), "c1 long, shared long").groupBy("c1").agg(F.sum("shared").alias("shared"))
    # l of the docstring, for the smallest partner that a set of this size can have; the whole overlap where that is less.
    least = f"cast(ceil({num} * n / {den}) as long)"
    wanted = f"least(cast(floor(3 * ({least}) / 20) as long) + 1, {least})"
    live = scratch.keep(classes.join(shared, "c1").where(f"shared >= {wanted}").select(F.col("rep").alias("id")).distinct(), "live")
    release(spark)
    n_live = live.count()
    sets = scratch.keep(
        source.join(maybe_broadcast(live, n_live), "id", "left_semi").mapInArrow(lambda it: _sets(it, width, SALTS), "id long, n long, hashes binary, keys array<long>"), "sets"
    )

    keyed = sets.select("id", F.posexplode("keys").alias("salt", "key"))
    grouped = _blocks(keyed, ["salt", "key"], BLOCK, scratch, "key-blocks").withColumn("block", F.pmod(F.xxhash64("id", "salt"), F.col("parts")).cast("int")).select("salt", "key", "block", "id")
    links = grouped.join(sets.select("id", F.col("id").alias("label"), "hashes"), "id").groupBy("salt", "key", "block").applyInArrow(tidy(lambda t: _block_links(t, num, den)), "a long, b long")
    first = scratch.keep(links.distinct(), "links")
    del links, grouped
    release(spark)
    labels = components(first, scratch, "first")
    named = sets.select("id", "hashes").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = named.join(labels.groupBy("label").count(), "label", "left").select("id", "label", F.coalesce("count", F.lit(1)).alias("count"), "hashes")
    named = scratch.keep(named, "named")
    scratch.drop("sets")

    counted = named.select("hashes").mapInArrow(lambda it: _holders(it, n_buckets), packed.SCHEMA)
    ranks = scratch.keep(counted.groupBy("bucket").applyInArrow(tidy(_ranked), "token long, level int"), "ranks")
    least_level, total = 64, 0
    for r in sorted(ranks.groupBy("level").count().collect(), key=lambda r: -r.level):
        total += r["count"]
        if total > MOST_RANKED:
            break
        least_level = r.level
    got = ranks.where(F.col("level") >= least_level).toArrow()
    order = Order(got.column("token").to_numpy().view(np.uint64), got.column("level").to_numpy())
    tokens = got.column("token").to_numpy().view(np.uint64)
    hot_hashes = _hosts(named, order, tokens[got.column("level").to_numpy() >= HOT_LEVEL])
    entries = lambda rows: rows.mapInArrow(lambda it: _prefix_entries(it, n_buckets, order, hot_hashes), packed.SCHEMA)
    visits = scratch.keep(entries(named).groupBy("bucket").applyInArrow(tidy(_visits), "id long, host long").distinct(), "visits")
    del counted
    release(spark)
    meetings = visits.withColumn("part", F.lit(0))
    hot = scratch.keep(visits.groupBy("host").count().where(F.col("count") > HOST_BLOCKS * BLOCK).select("host"), "hot-hosts")
    n_hot = hot.count()
    if n_hot:
        hot = maybe_broadcast(hot, n_hot)
        by_hash = _by_hash(hot, visits, entries, named, scratch)
        meetings = scratch.keep(meetings.join(hot, "host", "left_anti").unionByName(by_hash), "meetings")
    split = _blocks(meetings, ["host", "part"], BLOCK, scratch, "host-blocks").withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))
    # A visitor goes to the pair of blocks (its own, k) for each k: the number of blocks, not of visitors.
    dealt = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("host", "part", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "id")
    more = dealt.join(named.select("id", "label", "hashes"), "id").groupBy("host", "part", "one", "two").applyInArrow(tidy(lambda t: _block_links(t, num, den)), "a long, b long")
    more = scratch.keep(more, "more")
    del dealt, split
    release(spark)
    # A document that stands for several classes, because rows repeat its id, joins them.
    twice = scratch.keep(signed.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "twice")
    n_twice = twice.count()
    own = filled.join(maybe_broadcast(twice, n_twice), "id", "left_semi").join(classes, ["c1", "c2", "n"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    final = components(first.union(more).union(own) if n_twice else first.union(more), scratch, "final")
    scratch.drop("named", "visits", "links", "more", "ranks", "key-blocks", "host-blocks", *(("hot-ids", "hash-visits", "hash-parts", "meetings") if n_hot else ()))

    reps = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("c1", "c2", "n", F.coalesce("label", "rep").alias("component_id"))
    # Written first: a join right above the aggregate could not split the rows of a class with very many copies.
    reps = scratch.keep(reps, "reps")
    joined = signed.join(reps, ["c1", "c2", "n"], "left")
    if n_twice:
        named = scratch.keep(final.join(maybe_broadcast(twice, n_twice), "id", "left_semi").select("id", F.col("label").alias("own")), "named-twice")
        joined = joined.join(maybe_broadcast(named, n_twice), "id", "left").withColumn("component_id", F.coalesce("own", "component_id"))
    return joined.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, but of each group of linked documents only the one with the least id."""
    linked = link(docs, id_col, text_col, width).where("component_id <> id").select("id").distinct()
    gone = Scratch(docs.sparkSession, "jaccard-gone").keep(linked, "gone")
    gone = maybe_broadcast(gone, gone.count())
    return docs.join(gone, docs[id_col] == gone["id"], "left_anti")
