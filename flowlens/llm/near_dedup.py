"""Near-duplicate classes by a chosen-path set similarity join.

1. Texts become sets of word shingles; equal sets collapse into one class at once,
   so copies cost nothing below. A class keeps a MinHash signature: some coordinates
   choose paths, the others' low bytes are a sketch that estimates similarity.
2. Independent trees branch the classes: a tree's root sends a class to the child
   named by one chosen minwise token. Nodes with one class end; small ones are
   compared exhaustively, by sketch, inside a task; large ones branch again by
   coordinates that are chosen at random for the node. A node that stays large to
   the last level shares so many tokens that all of it is a candidate group.
3. What the sketches hold for possible links only forms candidate groups (connected
   components). Within each, links are decided exactly on the full shingle sets,
   and each class travels to its one group once. In a group too large for one task,
   a few classes are first held against all; only what they leave outside the
   group's largest component is then held against the whole group.

No pair is ever written out: nodes and groups give the edges of a spanning forest,
fewer than they have members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import batch, checkpointed, join_heavy, text_of
from flowlens.llm.components import connected_components
from flowlens.llm.shingles import WordHashes, mix64, words_of

#: Coordinates of a signature that choose paths, and those that make the sketch.
PATHS, SKETCH = 32, 96
#: Share of the linked pairs that share a last node of some tree, at the threshold and the last level.
RECALL = 0.995
#: Classes in a node that is compared exhaustively, at most; levels of branching below the root.
NODE_SIZE, LEVELS = 4096, 6
#: Standard errors by which a sketch may fall short of the threshold.
SLACK = 4.0
#: Classes and shingles of a group that one task links, at most; beyond, classes in a block, and those held against all first.
GROUP_SIZE, GROUP_SHINGLES, BLOCK_SIZE, PIVOTS = 8192, 4_000_000, 2048, 32

_MUL = np.uint64(0x9E3779B97F4A7C15)
_A = (mix64(np.arange(1, PATHS + SKETCH + 1, dtype=np.uint64) * _MUL) | np.uint64(1)).astype(np.uint32)
_B = mix64(np.arange(1001, PATHS + SKETCH + 1001, dtype=np.uint64) * _MUL).astype(np.uint32)


def trees(percent: int, recall: float = RECALL) -> int:
    """Independent trees that a pair at the threshold needs to meet in the last level of some with probability ``recall``.

    At a root, a pair of similarity s stays together with probability s. Below, a
    node chooses each coordinate with probability 1 / (s * PATHS): the nodes that hold
    both are a branching process with one child in the mean, so of the pairs together
    at one level 1 - exp(-q) keep a line to the last, q being the next level's share.
    """
    s, q = percent / 100, 1.0
    for _ in range(LEVELS):
        q = 1 - np.exp(-q)
    need = int(np.ceil(np.log(1 - recall) / np.log(1 - s * q)))
    if need > PATHS:
        raise ValueError(f"a recall of {recall} at {percent} % needs {need} trees; a signature has {PATHS} roots")
    return need


def shingle_sets(texts: list[str | None], hashes: WordHashes, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, hashed together (see ``shingles.shingle_set``)."""
    words = [words_of(t) for t in texts]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(lens.sum()))
    if len(flat) >= width:
        acc = flat[: len(flat) - width + 1].copy()
        for i in range(1, width):
            acc *= _MUL
            acc += flat[i : len(flat) - width + 1 + i]
        acc = mix64(acc + np.uint64(width))
    out, at = [], 0
    for n in lens.tolist():
        if n >= width:
            s = np.sort(acc[at : at + n - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in flat[at : at + n]:
                    h = h * _MUL + w
            out.append(mix64(np.array([h + np.uint64(n)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row of PATHS + SKETCH for each set; those of an empty set mean nothing."""
    out = np.zeros((len(sets), PATHS + SKETCH), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        part, n = [], 0
        while at < len(full) and (not part or n + len(sets[full[at]]) <= 1 << 16):
            part.append(full[at])
            n += len(sets[full[at]])
            at += 1
        flat = np.concatenate([sets[i] for i in part]).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in part])[:-1]))
        for c in range(PATHS + SKETCH):
            out[part, c] = np.minimum.reduceat(flat * _A[c] ^ _B[c], starts)
    return out


def _parts(texts: list, size: int = 1 << 19) -> Iterator[slice]:
    """Slices of a batch that hold about ``size`` characters, so that very long texts come alone."""
    at = begin = held = 0
    for at, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield slice(begin, at + 1)
            begin, held = at + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0)
            for part in _parts(texts):
                sets = shingle_sets(texts[part], hashes, width)
                sig = signatures(sets)
                low = sig[:, PATHS:].astype(np.uint8)
                yield batch(
                    doc_id=ids[part.start : part.stop],
                    n_shingles=pa.array([len(s) for s in sets], pa.int64()),
                    digest=pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    paths=pa.ListArray.from_arrays(np.arange(len(sig) + 1, dtype=np.int32) * PATHS, pa.array(np.ascontiguousarray(sig[:, :PATHS]).reshape(-1).view(np.int32))),
                    sketch=pa.array([s.tobytes() for s in low], pa.binary()),
                )

    return run


def _branch(share: float):
    """Children of a large node: it chooses each coordinate with the probability ``share``."""
    limit = np.uint64(int(share * 2.0**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate = np.arange(1, PATHS + 1, dtype=np.uint64) * _MUL
        for b in batches:
            if b.num_rows:
                node = b.column(0).to_numpy().view(np.uint64)
                sig = b.column(2).flatten().to_numpy().view(np.uint32).reshape(-1, PATHS)
                row, c = np.nonzero(mix64(node[:, None] ^ coordinate[None, :]) < limit)
                keys = mix64(mix64(node[row] + coordinate[c]) ^ sig[row, c].astype(np.uint64))
                yield batch(node=pa.array(keys.view(np.int64)), rep=pa.array(b.column(1).to_numpy()[row]))

    return run


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of equal first column in a partition sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        edges = [0, *cuts.tolist(), len(key)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            part = b.slice(lo, hi - lo)
            if held and held[0].column(0)[0] != part.column(0)[0]:
                yield held
                held = []
            held.append(part)
    if held:
        yield held


def forest(sketches: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the rows with ``least`` equal sketch bytes."""
    n = len(sketches)
    label, edges = np.arange(n), []
    for i in range(n - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        near = rest[(sketches[rest] == sketches[i]).sum(1) >= least]
        while len(near):
            j = near[0]
            edges.append((i, int(j)))
            label[label == label[j]] = label[i]
            near = near[label[near] != label[i]]
    return edges


def _compare(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for parts in _groups_of(batches):
            reps = np.concatenate([p.column(1).to_numpy() for p in parts])
            if len(reps) > 1:
                sketches = np.frombuffer(b"".join(chain.from_iterable(p.column(2).to_pylist() for p in parts)), np.uint8).reshape(-1, SKETCH)
                for i, j in forest(sketches, least):
                    u.append(int(max(reps[i], reps[j])))
                    v.append(int(min(reps[i], reps[j])))
            if len(u) >= 50_000:
                yield batch(u=pa.array(u, pa.int64()), v=pa.array(v, pa.int64()))
                u, v = [], []
        yield batch(u=pa.array(u, pa.int64()), v=pa.array(v, pa.int64()))

    return run


def exact_links(sets: list[np.ndarray], percent: int, firsts: int | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the sets with 100 * intersection >= percent * union.

    With ``firsts``, only links of the first so many sets with any are sought.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 0 < common and 100 * common >= percent * (sizes.sum() - common) else []
    flat = np.concatenate(sets)
    token = np.unique(flat, return_inverse=True)[1]
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(token, kind="stable")
    holders, count = owner[order], np.bincount(token)
    first, begin = np.concatenate(([0], np.cumsum(count)[:-1])), np.concatenate(([0], np.cumsum(sizes)))
    label, edges, parts = np.arange(n), [], n
    for i in range(n if firsts is None else firsts):
        mine = token[begin[i] : begin[i + 1]]
        mine = mine[count[mine] > 1]
        if not len(mine) or parts == 1:
            continue
        k = count[mine]
        at = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())
        common = np.bincount(holders[at], minlength=n)
        near = np.flatnonzero((common > 0) & (100 * common >= percent * (sizes + sizes[i] - common)) & (label != label[i]))
        while len(near):
            j = near[0]
            edges.append((i, int(j)))
            label[label == label[j]] = label[i]
            parts -= 1
            near = near[label[near] != label[i]]
    return edges


def _top(least: list[int], i: int) -> int:
    while least[i] != i:
        least[i] = least[least[i]]
        i = least[i]
    return i


def _link(width: int, percent: int):
    """Rows (task, rep, digest, first, text) of a partition, sorted by task, to a star for each component.

    Where a task has rows that are ``first``, only their links are sought, with any row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        u, v = [], []
        for parts in _groups_of(batches):
            sets: dict[tuple[int, bytes], np.ndarray] = {}
            first: set[tuple[int, bytes]] = set()
            for p in parts:
                ids, digests, texts = p.column(1).to_pylist(), p.column(2).to_pylist(), p.column(4).to_pylist()
                for rep, want, f, s in zip(ids, digests, p.column(3).to_pylist(), shingle_sets(texts, hashes, width)):
                    if f:
                        first.add((rep, want))
                    if (rep, want) not in sets and xxhash.xxh3_128_digest(s.tobytes()) == want:  # the id may have other texts
                        sets[rep, want] = s
            reps = sorted(sets, key=lambda r: (r not in first, r))
            if len(reps) > 1:
                top = list(range(len(reps)))  # of each one's component so far, by position
                for i, j in exact_links([sets[r] for r in reps], percent, len(first) or None):
                    low, high = sorted((_top(top, i), _top(top, j)))
                    top[high] = low
                least: dict[int, int] = {}
                for i, (rep, _) in enumerate(reps):
                    k = _top(top, i)
                    least[k] = min(rep, least.get(k, rep))
                for i, (rep, _) in enumerate(reps):
                    if rep != least[_top(top, i)]:
                        u.append(rep)
                        v.append(least[_top(top, i)])
        yield batch(u=pa.array(u, pa.int64()), v=pa.array(v, pa.int64()))

    return run


def _candidate_groups(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that some other may be linked with."""
    s = percent / 100
    least = int(np.floor(SKETCH * (s - SLACK * np.sqrt(s * (1 - s) / SKETCH))))
    reps = classes.select("rep", "paths")

    def shared(rows: DataFrame) -> DataFrame:
        return checkpointed(rows.join(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "node"))

    roots = reps.select("rep", F.posexplode(F.slice("paths", 1, trees(percent))))  # tree t's root chooses coordinate t
    now = shared(roots.select(F.xxhash64("pos", "col").alias("node"), "rep"))
    small, stars = now.where(F.col("n") <= NODE_SIZE), None
    for level in range(LEVELS + 1):
        large = now.where(F.col("n") > NODE_SIZE)
        if large.isEmpty():
            break
        if level == LEVELS:
            least_rep = large.groupBy("node").agg(F.min("rep").alias("v"))
            stars = large.join(least_rep, "node").select(F.col("rep").alias("u"), "v").where("u <> v").distinct()
            break
        children = large.select("node", "rep").join(reps, "rep").select("node", "rep", "paths").mapInArrow(_branch(1 / (s * PATHS)), "node long, rep long")
        now = shared(children)
        small = small.unionByName(now.where(F.col("n") <= NODE_SIZE))
    rows = small.select("node", "rep").join(classes.select("rep", "sketch"), "rep").select("node", "rep", "sketch")
    edges = rows.repartition("node").sortWithinPartitions("node").mapInArrow(_compare(least), "u long, v long")
    if stars is not None:
        edges = edges.unionByName(stars)
    return connected_components(edges)


def _linked(docs: DataFrame, tasks: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (u, v) that tie the classes of each task (rep, digest, task, first) to their component's least."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_of().alias("text"))
    rows = texts.join(tasks.hint("shuffle_hash"), "rep").select("task", "rep", "digest", "first", "text")
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(_link(width, percent), "u long, v long")


def _against_all(docs: DataFrame, large: DataFrame, some: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges of the links that the classes ``some`` have in their groups.

    A class of ``large`` (rep, digest, group, k, b) lies in block b of its group's k; each block meets
    each chunk of ``some`` (rep, digest, group, k, chunk) in one task. The groups are few: each
    has more than GROUP_SIZE classes or GROUP_SHINGLES shingles.
    """
    met = some.select("group", "chunk").distinct()
    blocks = large.join(F.broadcast(met), "group").select("rep", "digest", "group", "b", "chunk", F.lit(False).alias("first"))
    firsts = some.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select("rep", "digest", "group", "b", "chunk", F.lit(True).alias("first"))
    tasks = blocks.unionByName(firsts).groupBy("rep", "digest", F.xxhash64("group", "b", "chunk").alias("task")).agg(F.max("first").alias("first"))
    return _linked(docs, tasks, width, percent)


def _large_links(docs: DataFrame, large: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges of all links in groups too large for one task (rep, digest, n_shingles, group, members, shingles).

    PIVOTS classes are held against all of their group. Two classes that are not yet
    in one component can't both be in the largest, so what is left is to hold those
    outside it against all: exact, and as much work as the group is unlike.
    """
    k = F.greatest(F.ceil(F.col("members") / BLOCK_SIZE), F.ceil(F.col("shingles") / (GROUP_SHINGLES // 2)), F.lit(2))
    large = checkpointed(large.withColumn("k", k.cast("long")).withColumn("b", F.pmod(F.xxhash64("rep", "digest"), F.col("k"))))
    order = F.struct(F.xxhash64("rep", F.lit(7)).alias("h"), "rep", "digest")
    # the least hashes, found by a share of the members that shrinks with the group, then by number in it
    few = large.where(F.pmod(F.xxhash64("rep", F.lit(7)), F.col("members")) < 4 * PIVOTS)
    pivots = few.groupBy("group", "k").agg(F.slice(F.sort_array(F.collect_list(order)), 1, PIVOTS).alias("some"))
    pivots = pivots.select("group", "k", F.explode("some").alias("p")).select("group", "k", "p.rep", "p.digest", F.lit(0).cast("long").alias("chunk"))
    edges = checkpointed(_against_all(docs, large, pivots, width, percent))
    found = connected_components(edges).withColumnsRenamed({"node": "rep"})
    labelled = large.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = checkpointed(labelled)
    sizes = labelled.groupBy("group", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("group").agg(F.max(F.struct("n", F.col("component").alias("c"))).alias("top")).select("group", "top.c")
    rest = labelled.join(F.broadcast(largest), "group").where(F.col("component") != F.col("c"))  # a row for each large group
    if rest.isEmpty():
        return edges
    count = rest.groupBy("group").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    chunks = F.greatest(F.ceil(F.col("n") / BLOCK_SIZE), F.ceil(F.col("s") / (GROUP_SHINGLES // 2))).cast("long")
    some = rest.join(F.broadcast(count), "group").select("rep", "digest", "group", "k", F.pmod(F.xxhash64("rep", "digest", F.lit(1)), chunks).alias("chunk"))
    return edges.unionByName(_against_all(docs, large, some, width, percent))


def _exact_stars(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> tuple[DataFrame, bool]:
    """Edges (u, v) that tie each class to its component's least, and whether they are so for all groups already."""
    groups = checkpointed(_candidate_groups(classes, percent).withColumnsRenamed({"node": "rep", "component": "group"}).join(classes.select("rep", "digest", "n_shingles"), "rep"))
    sizes = checkpointed(groups.groupBy("group").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles")))
    large = (F.col("members") > GROUP_SIZE) | (F.col("shingles") > GROUP_SHINGLES)
    named = join_heavy(groups, sizes, "group", "members", "inner")
    small = named.where(~large).select("rep", "digest", F.col("group").alias("task"), F.lit(False).alias("first"))
    whole = sizes.where(large).isEmpty()
    if whole:
        return _linked(docs, small, width, percent), whole
    edges = _linked(docs, small, width, percent).unionByName(_large_links(docs, named.where(large), width, percent))
    return edges, whole


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Documents are linked whose sets of ``width``-word shingles have 100 * intersection
    >= percent * union; component_id is the least id reachable over links.

    A text of fewer words is one shingle; null and empty texts have an empty set,
    are linked with nothing and kept. Repeated rows give repeated rows, of one
    component; an id with several texts joins their components. A row without an id
    can't be named: its component_id is null and it is kept. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    profile = checkpointed(rows.mapInArrow(_profile(width), "doc_id long, n_shingles long, digest binary, paths array<int>, sketch binary"))
    # a class goes by its least id; an id with several texts may so be the node of several classes
    named = profile.where("n_shingles > 0 and doc_id is not null")
    classes = checkpointed(
        named.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")).withColumnRenamed("least", "rep")
    )
    wordless = profile.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("rep"))
    slim = profile.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "digest")
    member = join_heavy(slim, classes.select("digest", "rep", "copies"), "digest", "copies", "inner").select("doc_id", "n_shingles", "rep").unionByName(wordless)
    member = checkpointed(member.withColumn("rep", F.when(F.col("doc_id").isNotNull() & F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("rep"))))
    several = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("u")).where("u <> v").select("u", "v")  # ids with several texts
    stars, whole = _exact_stars(docs, classes, width, percent)
    if whole and several.isEmpty():
        found = stars.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
    else:
        found = connected_components(stars.unionByName(several))
    copies = classes.groupBy("rep").agg(F.sum("copies").alias("copies"))
    found = found.withColumnRenamed("node", "rep").join(copies, "rep", "full").withColumn("copies", F.coalesce("copies", F.lit(1)))
    keyed = member.where("rep is not null")
    joined = join_heavy(keyed, found, "rep", "copies").drop("copies").unionByName(member.where("rep is null").withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """``docs``, all columns, with one row of each near-duplicate group (see ``near_duplicates``).

    It is the row of the group's least id; of rows that repeat that id, one with the
    least text hash. Rows without an id or without words belong to no group and stay.
    """
    found = checkpointed(near_duplicates(docs, width, percent).where("doc_id is not null"))
    ids = found.groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_n"), F.max("n_shingles").alias("_words")).where("_kept")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # names of other columns can't clash
    named = rows.where(F.col("_id").isNotNull()).join(ids, "_id")
    repeated = (F.col("_n") > 1) & (F.col("_words") > 0)
    if not ids.where(repeated).isEmpty():
        order = Window.partitionBy("_id").orderBy(F.xxhash64("_text"), "_text")
        named = named.where(~repeated).unionByName(named.where(repeated).withColumn("_n", F.row_number().over(order).cast("long")).where("_n = 1"))
    return named.select("_row").unionByName(rows.where(F.col("_id").isNull()).select("_row")).select("_row.*")
