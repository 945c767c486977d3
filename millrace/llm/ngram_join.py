"""N-gram Jaccard join by a token-group matrix.

Documents are sets of distinct word shingles; equal sets form a class. The join goes from the whole corpus to few
classes in four steps, none of which loses a link:

1. Screen. A class of n shingles with a linked partner has at most n * (100 - percent) / 100 shingles of its own (that no other
   class has). Shingles of a fixed part of the hash space are counted over all classes, and a class with more of its own there is
   done: it links with nothing. A part of the space is enough, as texts without copies have nearly all shingles for themselves.
2. Tokens. The shingles of the classes left are counted among these and ordered from rare to common. A class's tokens are the
   shared shingles at the beginning of its order. A shingle at place i can be the first that two linked classes share only if
   the partner's size is at most (n - i) * (100 + percent) / percent - n: its reach. So common passages make no tokens, and
   classes with many shingles of their own have few.
3. Groups. Classes with the same least neighbour by tokens form groups of bounded size, which are compared inside; the groups of one
   such neighbour also meet one of them.
4. The token-group matrix. It holds the union of each group's tokens with the sizes and reaches behind them. Against it each class
   bounds its overlap with the groups whose classes it isn't connected with yet, and only groups that qualify are opened.

Comparison is exact on 64-bit shingle hashes (chance of any false link: about 1e-9 at a million documents). A group of near copies
costs one comparison within blocks and then only what stays unconnected, so no task and no table holds its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, bound_batches, fresh, give_back, key_texts, map_batches, materialise
from millrace.llm.components import components

#: The screen's part of the hash space, as a multiple of the largest share of own shingles; sets of up to SMALL are counted whole.
MARGIN, SMALL = 1.6, 40
#: Shingles of a chunk of classes that is looked up together, and of a bucket of the hash space that is counted together.
CHUNK, BUCKET = 400_000, 1_000_000
#: Bounds of one group: members and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000
#: So many rows of at most three longs are broadcast (some 50 MB as a hash table); beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Entries of a task's word cache and of its memory of classes already sent.
CACHE = 500_000
#: Copies of a class from which its label is broadcast and not shuffled: so many at least, and a share of all rows.
HOT_COPIES, HOT_SHARE = 64, 10_000

_M = np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser on arrays (wraps)."""
    x = (x ^ (x >> _S)) * _M
    x = (x ^ (x >> _S)) * _M
    return x ^ (x >> _S)


class WordHashes(dict):
    """bytes -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles. Words are runs of anything but ASCII white space, A-Z in lower case."""
    # bytes.lower() changes A-Z alone; bytes.split() splits at \x20 and \x09-\x0D alone
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    acc = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        acc = mix(acc + h[i : len(words) - n + 1 + i])
    return np.unique(acc)


def class_of(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def pack(keys: np.ndarray) -> bytes:
    """The upper 48 bits of each hash; they are enough for counting, where two that fall together only cost work."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack(data: pa.Scalar) -> np.ndarray:
    own = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 6)
    out = np.zeros((len(own), 8), np.uint8)
    out[:, 2:] = own
    return out.view("<u8").ravel()


def unpack_whole(data: pa.Scalar) -> np.ndarray:
    """The same from whole hashes."""
    return np.frombuffer(data.as_buffer(), "<u8") & ~np.uint64(0xFFFF)


class Chunks:
    """Numbers for chunks of a task's rows; a task that runs again gives the same ones."""

    def __init__(self):
        self.first, self.size = TaskContext.get().partitionId() << 32, 0

    def take(self, n: int) -> int:
        self.size += n
        return self.first + self.size // CHUNK


def scanned(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, digest, n_shingles, class, chunk, keys) for each row: class is the hash of the whole set, null for an empty one or a
    null doc_id. keys has the shingles of the screen's part of the space, null where the same task has sent the class before."""
    edge = _edge(percent)

    def make():
        cache, sent, chunks = WordHashes(), set(), Chunks()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, classes, chunk, keys = [], [], [], []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), width, cache)
                c = class_of(s) if len(s) and key.is_valid else None
                sizes.append(len(s))
                classes.append(c)
                if c is None or c in sent:
                    chunk.append(None)
                    keys.append(None)
                    continue
                if len(sent) >= CACHE:
                    sent.clear()
                sent.add(c)
                # partners of small sets are at most so large
                own = s if percent * len(s) <= 100 * SMALL else s[: np.searchsorted(s, edge)]
                chunk.append(chunks.take(len(own)))
                keys.append(pack(own))
            return pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(chunk, pa.int64()), pa.array(keys, pa.binary())],
                ["doc_id", "digest", "n_shingles", "class", "chunk", "keys"],
            )

        return step

    own = key_texts(docs).withColumn("digest", F.xxhash64("text"))
    return map_batches(own, make, "doc_id long, digest long, n_shingles long, class long, chunk long, keys binary")


def _edge(percent: int) -> np.uint64:
    """Where the screen's part of the hash space ends, in whole keys."""
    return np.uint64(min(2**64 - 1, int(2**64 * MARGIN * (100 - percent) / 100)) >> 16 << 16)


def common(rows: DataFrame, total: int, decode: Callable[[pa.Scalar], np.ndarray]) -> DataFrame:
    """(chunk, keys, counts): the keys of each chunk of rows (chunk, keys) that more than one class has, with the number of classes.

    Each chunk sends a key once, with its count, to the bucket of the hash space; so a key that all classes have is as
    many entries as there are chunks.
    """
    buckets = np.uint64(max(1, -(-total // BUCKET)))
    names = ["bucket", "chunk", "keys", "counts"]

    def sent(chunk: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        if not len(keys):
            return
        bucket = ((keys >> _S) * buckets) >> _S
        cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(keys)]
        parts = [(int(bucket[a]), chunk, pack(keys[a:b]), counts[a:b].astype("<u4").tobytes()) for a, b in zip(cut, cut[1:])]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.record_batch([pa.array([p[i] for p in parts], k) for i, k in enumerate(kinds)], names)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for batch in batches:
            for chunk, keys in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and (chunk != at or size > 2 * CHUNK):
                    yield from sent(at, held)
                    held, size = [], 0
                at = chunk
                held.append(decode(keys))
                size += len(held[-1])
        if held:
            yield from sent(at, held)
        held = []
        give_back()

    def count(rows: pa.Table) -> pa.Table:
        keys = [unpack(k) for k in rows["keys"]]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([np.frombuffer(c.as_buffer(), "<u4") for c in rows["counts"]])).astype(np.int64)
        total = np.minimum(total, 2**32 - 1)[place]
        ends = np.cumsum([0] + [len(k) for k in keys])
        out = []
        for i, chunk in enumerate(rows["chunk"].to_pylist()):
            n = total[ends[i] : ends[i + 1]]
            if (n > 1).any():
                out.append((chunk, pack(keys[i][n > 1]), n[n > 1].astype("<u4").tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary())
        found = pa.table([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names[1:])
        keys = every = place = total = out = None
        give_back()
        return found

    bound_batches(rows.sparkSession)
    return rows.select("chunk", "keys").mapInArrow(split, "bucket long, chunk long, keys binary, counts binary").groupBy("bucket").applyInArrow(count, "chunk long, keys binary, counts binary")


def _counts(keys: list[np.ndarray], known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all keys, the row of each, the number of classes that have it) for the rows of a chunk."""
    every = np.concatenate([*keys, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    n = np.ones(len(every), np.int64)
    if known.num_rows:
        shared = np.concatenate([unpack(k) for k in known["keys"]])
        counts = np.concatenate([np.frombuffer(c.as_buffer(), "<u4") for c in known["counts"]])
        order = np.argsort(shared, kind="stable")
        shared, counts = shared[order], counts[order]
        at = np.minimum(np.searchsorted(shared, every), len(shared) - 1)
        n = np.where(shared[at] == every, counts[at], 1).astype(np.int64)
    return every, owner, n


def screened(rows: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(class): the classes that may have a partner, of rows as scanned() gives them. label has (class, senders, holder): how many
    rows of a class have keys, and the least doc_id of those."""
    sent = rows.filter("keys is not null")
    # a class that several tasks have sent counts once
    several = _small(label.filter("senders > 1").select(F.col("class").alias("__class"), "holder"))
    sent = sent.join(several, F.col("class") == F.col("__class"), "left").filter("holder is null OR holder = doc_id")
    sent = sent.select("chunk", "class", F.col("n_shingles").alias("n"), "keys")
    total = sent.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    edge = _edge(percent)

    def left_over(own: pa.Table, known: pa.Table) -> pa.Table:
        sizes = own["n"].to_numpy()
        keys, owner, n = _counts([unpack(k) for k in own["keys"]], known)
        alone = (n == 1) & ((keys < edge) | (sizes[owner] <= SMALL))
        count = np.bincount(owner[alone], minlength=len(sizes))
        return pa.table({"class": own["class"].to_numpy()[count <= sizes * (100 - percent) // 100]})

    return sent.groupBy("chunk").cogroup(common(sent, total // 6, unpack).groupBy("chunk")).applyInArrow(left_over, "class long")


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(class, n, chunk, shingles) of the classes of ids (class, doc_id), from the texts again."""

    def make():
        cache, chunks = WordHashes(), Chunks()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(c, s) for c, s in zip(batch.column(0).to_pylist(), (shingle_set(t.as_py(), width, cache) for t in batch.column(1)), strict=True) if class_of(s) == c]
            return pa.record_batch(
                [pa.array([c for c, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([chunks.take(len(s)) for _, s in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())],
                ["class", "n", "chunk", "shingles"],
            )

        return step

    # the texts stay where they are if the ids are few enough to send; else both are shuffled
    texts = key_texts(docs).join(_small(ids.select("class", "doc_id")), "doc_id").select("class", "text")
    return map_batches(texts, make, "class long, n long, chunk long, shingles binary")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows; for frames of a few longs that are cheap to count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def tokens(sets: DataFrame, percent: int) -> DataFrame:
    """(token, class, n, reach) of the classes of sets; see the module for both."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    keys = sets.select("chunk", F.col("shingles").alias("keys"))

    def chosen(own: pa.Table, known: pa.Table) -> pa.Table:
        sizes = own["n"].to_numpy()
        every, owner, n = _counts([unpack_whole(k) for k in own["shingles"]], known)
        own_alone = np.bincount(owner[n == 1], minlength=len(sizes))
        every, owner, n = every[n > 1], owner[n > 1], n[n > 1]
        order = np.lexsort((every, n, owner))
        every, owner = every[order], owner[order]
        before = np.searchsorted(owner, np.arange(len(sizes)))
        size = sizes[owner]
        place = own_alone[owner] + np.arange(len(owner)) - before[owner]
        reach = (size - place) * (100 + percent) // percent - size
        ok = 100 * reach >= percent * size
        return pa.table({"token": every[ok].view(np.int64), "class": own["class"].to_numpy()[owner[ok]], "n": size[ok], "reach": reach[ok]})

    return sets.groupBy("chunk").cogroup(common(keys, total, unpack_whole).groupBy("chunk")).applyInArrow(chosen, "token long, class long, n long, reach long")


def _links(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]] | None, percent: int) -> Iterator[tuple[int, int]]:
    """What is linked inside a group (b is None) or between queries and a group: each class with the least one it is connected to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    others = a if b is None else b
    held = np.concatenate([s for _, s in others])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], np.repeat(np.arange(len(others)), [len(s) for _, s in others])[order]
    sizes = np.array([len(s) for _, s in others])
    for i, (x, s) in enumerate(a):
        low, high = np.searchsorted(held, s), np.searchsorted(held, s, "right")
        n = high - low
        if 100 * np.count_nonzero(n) < percent * len(s):
            continue  # the group's union of shingles can't reach a link
        ends = np.cumsum(n)
        both = np.bincount(owner[np.arange(ends[-1]) + np.repeat(low - ends + n, n)], minlength=len(others))
        for j in np.flatnonzero(100 * both >= percent * (sizes + len(s) - both)).tolist():
            y = others[j][0]
            if x != y and (b is not None or j < i):
                low_root, high_root = sorted((root(x), root(y)))
                parent[high_root] = low_root
    yield from ((x, root(x)) for x in list(parent) if root(x) != x)


def _first(item: tuple) -> int:
    return item[0]


def _opened(percent: int):
    """For applyInArrow: the links of one group, or of queries with one opened group (rows marked by side)."""

    def run(rows: pa.Table) -> pa.Table:
        sides: tuple[dict, dict] = ({}, {})
        for side, c, s in zip(rows["side"].to_pylist(), rows["class"].to_pylist(), rows["shingles"], strict=True):
            sides[side].setdefault(c, np.frombuffer(s.as_buffer(), np.uint64))
        out = list(_links(sorted(sides[0].items(), key=_first), sorted(sides[1].items(), key=_first) or None, percent)) if sides[0] else []
        return pa.table({"u": pa.array([e[0] for e in out], pa.int64()), "v": pa.array([e[1] for e in out], pa.int64())})

    return run


def connected(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(class, component) for the classes of sets that are connected with others; component is its least class."""
    every = scratch.write(tokens(sets, percent))
    shared = every.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("token", "low")
    rows = scratch.write(every.join(shared, "token"))
    # a group: the classes with the same least neighbour, in blocks of bounded size
    lead = scratch.write(rows.groupBy("class").agg(F.min("low").alias("lead"), F.first("n").alias("n")))
    blocks = lead.groupBy("lead").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")).filter("blocks > 1")
    member = scratch.write(lead.join(_small(blocks), "lead", "left").select("class", "n", "lead", F.xxhash64("lead", F.coalesce(F.pmod(F.xxhash64("class"), "blocks"), F.lit(0))).alias("group")))
    placed = sets.select("class", "shingles").join(_small(member.select("class", "group")), "class")
    run = _opened(percent)

    shape = "u long, v long"
    several = member.groupBy("group").agg(F.count("*").alias("k")).filter("k > 1").select("group")
    inside = placed.join(several, "group").select("group", F.lit(0).alias("side"), "class", "shingles").groupBy("group").applyInArrow(run, shape)

    # the blocks of one lead meet the one with its least class first, which is linear in their number
    hub = member.groupBy("lead").agg(F.min_by("group", "class").alias("hub"), F.min("group").alias("least"), F.max("group").alias("most")).filter("least <> most").select("lead", "hub")
    spoke = member.select("lead", "group").distinct().join(hub, "lead").filter("group <> hub").select(F.col("group").alias("spoke"), "hub")
    sides = [spoke.select("spoke", F.lit(i).alias("side"), F.col(c).alias("group")) for i, c in enumerate(("spoke", "hub"))]
    spokes = sides[0].unionByName(sides[1]).join(placed, "group").select("spoke", "side", "class", "shingles").groupBy("spoke").applyInArrow(run, shape)
    known = scratch.write(components(inside.unionByName(spokes), scratch=scratch))

    # the token-group matrix, without what is connected already
    at = member.join(known, member["class"] == known["vertex"], "left").select(member["class"], "group", F.coalesce("component", "class").alias("component"))
    at = scratch.write(at)
    spot = rows.select("token", "class", "n", "reach").join(_small(at), "class")
    spread = spot.groupBy("token").agg(*(f(c).alias(f"{n}_{c}") for c in ("group", "component") for n, f in (("least", F.min), ("most", F.max))))
    spot = scratch.write(spot.join(spread.filter("least_group <> most_group AND least_component <> most_component").select("token"), "token"))
    matrix = spot.groupBy("token", "group", "component").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    q, m = spot.alias("q"), matrix.alias("m")
    fits = (F.col("q.token") == F.col("m.token")) & (F.col("q.group") > F.col("m.group")) & (F.col("q.component") != F.col("m.component")) & (F.col("q.n") <= F.col("m.most")) & (F.col("m.least") <= F.col("q.reach"))
    queries = scratch.write(q.join(m, fits).select("q.class", "q.n", F.col("m.group").alias("group")).distinct())
    load = queries.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    queries = queries.join(load, "group").select("group", "class", F.pmod(F.xxhash64("class"), "parts").alias("part"))
    asked = queries.join(sets.select("class", "shingles"), "class").select("group", "part", F.lit(0).alias("side"), "class", "shingles")
    asking = placed.join(queries.select("group", "part").distinct(), "group").select("group", "part", F.lit(1).alias("side"), "class", "shingles")
    more = scratch.write(asked.unionByName(asking).groupBy("group", "part").applyInArrow(run, shape))
    if more.isEmpty():
        return known.select(F.col("vertex").alias("class"), "component")

    # what the opened groups add connects components
    of = at.select("class", "component")
    edges = more.join(of, more["u"] == of["class"]).select(F.col("component").alias("a"), "v").join(of, F.col("v") == of["class"]).select("a", F.col("component").alias("b"))
    merged = scratch.write(components(edges, "a", "b", scratch=scratch)).select("vertex", F.col("component").alias("merged"))
    out = at.join(merged, at["component"] == merged["vertex"], "left").select("class", F.coalesce("merged", "component").alias("component"))
    return out


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id) for every row; digest is a hash of the text."""
    rows = materialise(scanned(docs, width, percent))
    holder = F.min(F.when(F.col("keys").isNotNull(), F.col("doc_id")))
    label = materialise(rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.count("keys").alias("senders"), holder.alias("holder")))
    with Scratch(docs.sparkSession) as scratch:
        left = scratch.write(screened(rows, label, percent).distinct())
        sets = scratch.write(shingle_sets(docs, label.join(left, "class"), width))
        found = connected(sets, percent, scratch).join(label, "class").select("class", "component", "doc_id")
        best = found.groupBy("component").agg(F.min("doc_id").alias("best"))
        label = materialise(label.join(found.join(best, "component").select("class", "best"), "class", "left").select("class", "copies", F.coalesce("best", "doc_id").alias("component_id")))
    # labels of classes with very many copies are sent to the rows, which are at most HOT_SHARE labels; the others meet theirs by class
    total = label.agg(F.sum("copies")).first()[0] or 0
    hot = max(HOT_COPIES, total // HOT_SHARE)
    own = rows.select("doc_id", "digest", "n_shingles", "class")
    own = own.join(F.broadcast(label.filter(F.col("copies") > hot).select("class", "component_id")), "class", "left")
    done = own.filter("component_id is not null OR class is null")
    rest = own.filter("component_id is null AND class is not null").drop("component_id").join(label.filter(F.col("copies") <= hot).select("class", "component_id"), "class")
    out = done.unionByName(rest.select(*done.columns))
    return out.select("doc_id", "digest", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links, itself included. Null or wordless texts have no
    shingles and link with nothing; a text of fewer words than width is one shingle; equal sets link. Repeated rows
    give repeated results. A row whose doc_id is null links with nothing; its component_id is null. No rows give no rows.
    """
    return _labelled(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def keep_representatives(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """The rows of docs, with all columns, but for near copies: of each component the document with the smallest doc_id stays.

    A document is a doc_id with a text: where one doc_id has several texts, each stays or goes with its own component, and of
    several texts of the smallest doc_id in one component one stays. Of rows that repeat both one stays. Rows without words
    stay but for repeated ones, rows without doc_id all stay.
    """
    names = [f"`{c}`" for c in docs.columns]
    found = materialise(_labelled(docs, width, percent))
    again = materialise(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    n = again.count()
    gone = found.filter("component_id < doc_id")
    if n:
        # texts of one doc_id in one component: the one with the least digest stays, texts without words each for itself
        twice = found.join(F.broadcast(again) if n <= BROADCAST_ROWS else again, "doc_id", "left_semi").filter("component_id = doc_id AND n_shingles > 0")
        least = twice.groupBy("doc_id").agg(F.min("digest").alias("least"))
        gone = gone.select("doc_id", "digest").unionByName(twice.join(least, "doc_id").filter("digest <> least").select("doc_id", "digest"))
    own_id, own_digest = fresh(docs, "id_of"), fresh(docs, "digest_of")
    gone = materialise(gone.select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest)).distinct())
    same_id = F.col("doc_id").cast("long") == F.col(own_id)
    kept = docs.join(_small(gone), same_id & (F.xxhash64(F.col("text").cast("string")) == F.col(own_digest)), "left_anti").select(*names)
    if n == 0:
        return kept
    again = again.select(F.col("doc_id").alias(own_id))
    again = F.broadcast(again) if n <= BROADCAST_ROWS else again
    once = kept.join(again, same_id, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same_id, "left_anti").select(*names).unionByName(once.select(*names))
