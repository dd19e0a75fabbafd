"""N-gram Jaccard self-join by T-occurrence search.

Two texts of x and y distinct shingles are linked at similarity 0.9 exactly
when they share T = ceil(9 / 19 * (x + y)) of them (in general from
``SIMILARITY``). The search for a set merges its short inverted lists, keeps
what occurs often enough there, and looks the survivors up in the long lists
(DivideSkip).

Routing. Sets that differ in at most d shingles agree on at least two of d + 2
parts into which a hash cuts the shingles. Each set sends a signature of each
part, for the size class of the smaller set of a pair (its own, and the class
below for pairs in which it is the larger), so every pair of linked texts
meets in a signature: nothing is lost. Parts without shingles are no evidence
and are left out. Only when all parts in which a pair agrees are empty in both
does it need another signature: of c such parts, at most c - 2 others differ in
two shingles or more, so among the first parts of a set, as many as c - 1 more
than those with fewer than two shingles, one differs in exactly one. A set with
several empty parts therefore also sends these first parts whole and with each
shingle left out. Their number grows with the size of the set, not its square.
(A set too small to have so many parts sends the pairs of its empty ones.)
A signature that over ``SLICE_SHARE`` texts of a slice share is combined before
the shuffle, so one that a third of all texts share arrives once per slice.

Texts that agree in a part by chance (a common phrase) would tie most of a
corpus together. So the texts of a signature are compared by sketches, the
counts of their shingles in ``CELLS`` or more hash cells: the counts of linked
texts differ by no more than the texts do, so a pair whose counts differ by more is
not linked, and only the others are tied. (Signatures combined before the
shuffle, or of more than ``SIGNATURE_TEXTS`` texts, tie all their texts.)

Tied texts form coarse groups; each is one inverted index in one task. A group over ``GROUP_CHARS`` characters is cut into hash blocks
and every pair of blocks is one task, each pair of texts being counted once.

Defined cases: a null or empty text, or one without words, has no shingles and
no links; one with fewer words than a shingle has its whole sequence as its
only shingle; rows with a null id are counted but never linked, and get a null
component; rows that share an id are one node of the links but rows of their
own in counts; repeated texts are linked; an empty table gives no rows; columns
besides id and text are not read. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, stash, table, two_columns
from .components import components
from .shingles import mix, shingle_sets
from .tokens import clear_worker, release_memory, text_slices

WORDS = 3
SIMILARITY = (90, 100)          # intersection to union, as a fraction
SLICE_CHARS = 1_500_000
SLICE_SHARE = 32                # texts of a slice with one signature that are sent one by one
SIGNATURE_TEXTS = 500           # texts of a signature whose sketches are compared
CELLS = 64                      # of a sketch, at least
GROUP_CHARS = 8_000_000
MEMBERS_BROADCAST = 1_000_000
SKIP = 0.0085                   # DivideSkip's weight of a list's logarithm


class Classes:
    """Size classes: the sizes up to 1 / similarity times a class's smallest
    are one class, so linked sets are in the same or in neighbouring ones."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole, self.low = part, whole, [1]

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * self.whole // self.part + 1)
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def parts(self, level: int) -> int:
        """Two parts more than linked sets can differ in shingles when the
        smaller one is in class ``level``."""
        x = self.low[level] * self.whole // self.part       # the class's largest size
        y = x * self.whole // self.part
        return (x + y) * (self.whole - self.part) // (self.whole + self.part) + 2


def signatures(hashes: np.ndarray, sizes: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of the text) of many sets."""
    own = np.array([classes.of(int(n)) for n in sizes], np.int64)
    out, owner = [], []
    for below in (0, 1):
        level = own - below
        use = (sizes > 0) & (level >= 0)
        k = np.array([classes.parts(v) if u else 0 for v, u in zip(level.tolist(), use.tolist())], np.int64)
        base = np.cumsum(k) - k
        text = np.repeat(np.arange(len(sizes)), sizes)
        keep = use[text]
        h, text = hashes[keep], text[keep]
        part = ((h >> np.uint64(32)) * k[text].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        at, total = base[text] + part, int(k.sum())
        spread = mix(h + np.uint64(0x51ED27))
        # sums of the two halves stay exact in a double
        low = np.bincount(at, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
        high = np.bincount(at, (spread >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
        held = np.bincount(at, minlength=total)
        filled = held > 0
        of = np.repeat(np.arange(len(sizes)), k)
        number = np.arange(total) - base[of]
        seed = mix(level[of].astype(np.uint64) * np.uint64(1 << 32) + number.astype(np.uint64))
        out.append(mix(seed + mix(low) + mix(high ^ np.uint64(0xA5A5))).astype(np.uint64)[filled])
        owner.append(of[filled])
        # sets that may agree with a partner in empty parts alone: their first parts, whole and less one shingle
        hollow = np.bincount(of[~filled], minlength=len(sizes))
        first = np.bincount(of[held < 2], minlength=len(sizes)) + hollow - 1
        sent = filled & (hollow > 1)[of] & (number < first[of])
        less = mix(seed + np.uint64(0x1E55))
        out.append(mix(less + mix(low) + mix(high ^ np.uint64(0xA5A5)))[sent])
        owner.append(of[sent])
        one = (sent & (held > 1))[at]
        there, spread = at[one], spread[one]
        out.append(mix(less[there] + mix(low[there] - (spread & np.uint64(0xFFFFFFFF))) + mix((high[there] - (spread >> np.uint64(32))) ^ np.uint64(0xA5A5))))
        owner.append(of[there])
        # of sets with too few parts for that, the pairs of empty ones
        for i in np.flatnonzero((hollow > 1) & (first > k)).tolist():
            gaps = number[base[i]:base[i] + k[i]][~filled[base[i]:base[i] + k[i]]]
            a, b = np.triu_indices(len(gaps), 1)
            pair = gaps[a].astype(np.uint64) * np.uint64(1 << 24) + gaps[b].astype(np.uint64)
            out.append(mix(pair + mix(np.array([level[i] + (1 << 50)], np.uint64))))
            owner.append(np.full(len(pair), i))
    return np.concatenate(out), np.concatenate(owner)


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Shingles of each text in each hash cell, modulo 256; a power of two of
    cells, one for 4 to 8 shingles of a long text."""
    cells = np.maximum(CELLS, 1 << np.ceil(np.log2(np.maximum(sizes, 8) / 8)).astype(np.int64))
    ends = np.cumsum(cells)
    spread = (mix(hashes + np.uint64(0x7C15)) >> np.uint64(32)).astype(np.int64)
    at = np.repeat(ends - cells, sizes) + spread % np.repeat(cells, sizes)
    counts = np.bincount(at, minlength=int(cells.sum())).astype(np.uint8).tobytes()
    return [counts[i:j] for i, j in zip((ends - cells).tolist(), ends.tolist())]


class Sketches:
    """Sketches of many texts, folded to common numbers of cells."""

    def __init__(self, raw: list[bytes], sizes: np.ndarray):
        self.sizes, self.cells = sizes, np.array([len(r) for r in raw], np.int64)
        data, begin = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.cells) - self.cells
        self.levels = {}
        for level in [CELLS, *np.unique(self.cells[self.cells > CELLS]).tolist()]:
            rows = np.flatnonzero(self.cells >= level)
            folded, place = np.zeros((len(rows), level), np.uint8), np.zeros(len(raw), np.int64)
            place[rows] = np.arange(len(rows))
            for n in np.unique(self.cells[rows]).tolist():
                own = np.flatnonzero(self.cells == n)
                folded[place[own]] = data[begin[own][:, None] + np.arange(n)].reshape(len(own), n // level, level).sum(1, dtype=np.uint8)
            self.levels[level] = folded, place

    def may_link(self, a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
        """Whether texts a and b (places) can be linked: linked sets of x and y
        shingles differ in (x + y) * (1 - s) / (1 + s) at most."""
        part, whole = similarity
        x, y, fewer = self.sizes[a], self.sizes[b], np.minimum(self.cells[a], self.cells[b])
        near = np.abs(x - y) * (whole + part) <= (x + y) * (whole - part)
        for level, (folded, place) in self.levels.items():
            asked = np.flatnonzero(near & ((fewer == level) | (level == CELLS)))
            step = max(1, (1 << 21) // level)
            for at in range(0, len(asked), step):
                i = asked[at:at + step]
                apart = np.abs((folded[place[a[i]]] - folded[place[b[i]]]).view(np.int8).astype(np.int16)).sum(1, dtype=np.int64)
                near[i] = apart * (whole + part) <= (x[i] + y[i]) * (whole - part)
        return near


def ties(group: np.ndarray, texts: Sketches, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that connect, within each run of equal ``group``, all
    texts that can be linked."""
    rows = np.arange(len(group))
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    length = np.diff(np.append(begin, len(group)))
    run, end = np.repeat(np.arange(len(begin)), length), np.repeat(begin + length, length)
    a = rows[:-1][run[1:] == run[:-1]]
    near = texts.may_link(a, a + 1, similarity)
    out = [(a[near], a[near] + 1)]
    # where all neighbours are tied, so is the run; else every other pair is compared
    broken = np.bincount(run[a[~near]], minlength=len(begin)) > 0
    left, gap = rows[broken[run] & (rows + 2 < end)], 2
    while len(left):
        near = texts.may_link(left, left + gap, similarity)
        out.append((left[near], left[near] + gap))
        gap += 1
        left = left[left + gap < end[left]]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few edges that join the same nodes as all edges (a, b): each node and
    the smallest one that they lead it to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[root[moved]], nodes[moved]


def t_occurrence(sets: list[np.ndarray], similarity: tuple[int, int]):
    """Yield (i, partners): the linked sets before set i, for distinct sets
    sorted by size."""
    part, whole = similarity
    sizes = np.array([len(s) for s in sets], np.int64)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(shingle, kind="stable")
    lists, n = owner[order], len(sets)
    begin = np.concatenate([[0], np.cumsum(np.bincount(shingle))])
    keys = shingle[order] * n + lists               # sorted: for binary probes
    ends = np.cumsum(sizes)

    def merged(of: np.ndarray, first: int, i: int) -> np.ndarray:
        """Occurrences of sets first..i-1 in the lists ``of``."""
        long = begin[of + 1] - begin[of]
        at = np.repeat(begin[of] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
        got = lists[at]
        return np.bincount(got[(got >= first) & (got < i)] - first, minlength=i - first)

    for i in range(1, n):
        x = int(sizes[i])
        first = int(np.searchsorted(sizes, -(-part * x // whole)))
        if first >= i:
            continue
        own = shingle[ends[i] - x:ends[i]]
        least = -(-part * (x + int(sizes[first])) // (part + whole))      # T of the smallest partner
        by_length = own[np.argsort(begin[own + 1] - begin[own], kind="stable")]
        longest = int(begin[by_length[-1] + 1] - begin[by_length[-1]])
        skip = min(least - 1, int(least / (SKIP * np.log2(max(2, longest)) + 1)))
        short, far = by_length[:x - skip], by_length[x - skip:]
        count = merged(short, first, i)
        found = np.flatnonzero(count >= least - skip)
        if not len(found):
            continue
        count = count[found]
        probes = len(found) * len(far)
        if probes * np.log2(max(2, longest)) > int((begin[far + 1] - begin[far]).sum()):
            count = count + merged(far, first, i)[found]        # merging them all is cheaper
        elif probes:
            want = (far[:, None] * n + (found + first)[None, :]).ravel()
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            count = count + (keys[at] == want).reshape(len(far), -1).sum(0)
        linked = found[whole * count >= part * (x + sizes[found + first] - count)]
        if len(linked):
            yield i, linked + first


def link_group(nodes: list, texts: list[str], sides: np.ndarray | None, words: int, similarity) -> tuple[list, np.ndarray]:
    """(root, links) of each text of a group; ``sides`` (0 or 1): only links
    between the two sides are counted."""
    hashes, sizes = shingle_sets(texts, words)
    ends = np.cumsum(sizes)
    by_set: dict[bytes, int] = {}
    sets, of = [], np.zeros(len(texts), np.int64)
    for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
        s = hashes[a:b]
        of[i] = by_set.setdefault(s.tobytes(), len(sets))
        if of[i] == len(sets):
            sets.append(s)
    rank = np.argsort([len(s) for s in sets], kind="stable")
    place = np.empty(len(sets), np.int64)
    place[rank] = np.arange(len(sets))
    of, sets = place[of], [sets[r] for r in rank]
    side = np.zeros(len(texts), np.int64) if sides is None else sides
    weight = np.stack([np.bincount(of[side == s], minlength=len(sets)) for s in (0, 1)])
    met = weight.copy()                 # rows of each side linked to a set, its own rows included
    parent = np.arange(len(sets))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, partners in t_occurrence(sets, similarity):
        met[:, i] += weight[:, partners].sum(1)
        met[:, partners] += weight[:, [i]]
        for root in {find(p) for p in partners.tolist()}:
            parent[find(i)] = root
    links = met[0, of] - 1 if sides is None else met[1 - side, of]
    roots = np.array([find(i) for i in range(len(sets))])[of]
    smallest: dict[int, int] = {}
    for node, root in zip(nodes, roots.tolist()):
        smallest[root] = min(node, smallest.get(root, node))
    return [smallest[r] for r in roots.tolist()], links


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       similarity: tuple[int, int] = SIMILARITY, group_chars: int = GROUP_CHARS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest
    id reachable by links), n_links (linked rows)."""
    docs = two_columns(df, id_col, text_col)

    def send(batches):
        clear_worker()
        classes = Classes(*similarity)
        for ids, texts in text_slices(batches, SLICE_CHARS):
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            hashes, sizes = shingle_sets([texts[i] for i in order], words)
            known = sum(i is not None for i in ids)
            node = np.array([ids[i] or 0 for i in order], np.int64)
            sig, of = signatures(hashes[:int(sizes[:known].sum())], sizes[:known], classes)
            # a signature of many texts of this slice: its first stands for all, each tied to it by a signature of their own
            common, first, again, shared = np.unique(sig, return_index=True, return_inverse=True, return_counts=True)
            many = shared > SLICE_SHARE
            a, b = node[of], node[of[first][again]]
            tied = many[again] & (a != b)
            pairs = np.unique(np.stack([a[tied], b[tied]]), axis=1)
            tie = mix(mix(pairs[0].astype(np.uint64)) + pairs[1].astype(np.uint64))
            alone = ~many[again]
            rows = [(sig[alone], a[alone], 0), (common[many], node[of[first[many]]], 1), (tie, pairs[0], 1), (tie, pairs[1], 1)]
            n_rows = sum(len(x) for x, _, _ in rows)
            missing = np.concatenate([np.ones(n_rows, bool), np.zeros(len(node), bool)])
            nodes = np.concatenate([*(v for _, v, _ in rows), node])
            no_id = np.concatenate([np.zeros(n_rows, bool), np.arange(len(node)) >= known])
            spread = np.concatenate([*(x for x, _, _ in rows), mix(node.astype(np.uint64))]).view(np.int64)
            sure = np.concatenate([*(np.full(len(x), k, np.int8) for x, _, k in rows), np.zeros(len(node), np.int8)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread), pa.array(nodes, mask=no_id), pa.array(np.concatenate([np.zeros(n_rows, np.int64), sizes]), mask=missing), pa.array(sure),
                 pa.array([None] * n_rows + sketches(hashes, sizes), pa.binary())],
                ["sig", "node", "n", "sure", "sketch"])

    def meet(batches):
        """Rows of three kinds: ties (a, b), texts of a signature to compare
        (sig, a), and texts (a, n, sketch)."""
        def signature_rows(sig, node, sure):
            """Of whole signatures: those to compare, and ties of the others."""
            begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            length = np.diff(np.append(begin, len(sig)))
            all_tied = (np.maximum.reduceat(sure, begin) > 0) | (length > SIGNATURE_TEXTS)
            run = np.repeat(np.arange(len(begin)), length)
            pair = all_tied[run[1:]] & (run[1:] == run[:-1])
            edges = np.unique(np.stack([node[1:][pair], node[:-1][pair]]), axis=1)
            edges = edges[:, edges[0] != edges[1]]
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
            asked = new & (~all_tied & (np.add.reduceat(new.astype(np.int64), begin) > 1))[run]
            return edges, sig[asked], node[asked]

        def out(edges, sig, node, rows):
            none, n_pairs, n_asked = pa.nulls, edges.shape[1], len(sig)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(edges[0]), pa.array(node), rows.column(1)]), pa.concat_arrays([pa.array(edges[1]), none(n_asked + len(rows), pa.int64())]),
                 pa.concat_arrays([none(n_pairs, pa.int64()), pa.array(sig), none(len(rows), pa.int64())]),
                 pa.concat_arrays([none(n_pairs + n_asked, pa.int64()), rows.column(2)]), pa.concat_arrays([none(n_pairs + n_asked, pa.binary()), rows.column(4)])],
                ["a", "b", "sig", "n", "sketch"])

        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8))
        for batch in batches:
            is_row = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            signed = batch.filter(pa.array(~is_row))
            held = tuple(np.concatenate([h, signed.column(c).to_numpy()]) for h, c in zip(held, (0, 1, 3)))
            rows = batch.filter(pa.array(is_row))
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if len(held[0]) - whole > 2 * SIGNATURE_TEXTS:      # an unfinished signature that ties all: two of its texts go on
                held[2][whole:] = 1
                done, held = held, tuple(h[[-1]] for h in held)
            else:
                done, held = tuple(h[:whole] for h in held), tuple(h[whole:] for h in held)
            yield out(*(signature_rows(*done) if len(done[0]) else (np.zeros((2, 0), np.int64), *done[:2])), rows)
        if len(held[0]):
            empty = pa.RecordBatch.from_arrays([pa.nulls(0, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary())], ["sig", "node", "n", "sure", "sketch"])
            yield out(*signature_rows(*held), empty)
        release_memory()

    def compare(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            sig = held.column(0).to_numpy()
            whole = int(np.searchsorted(sig, sig[-1])) if len(sig) else 0
            yield tied_rows(held.slice(0, whole))
            held = held.slice(whole)
        if held is not None:
            yield tied_rows(held)
        release_memory()

    def tied_rows(rows):
        a = b = np.zeros(0, np.int64)
        if len(rows):
            sig, node, sizes = (rows.column(c).to_numpy() for c in range(3))
            i, j = ties(sig, Sketches(rows.column(3).to_pylist(), sizes), similarity)
            # only who is joined counts, and a signature's ties grow with the square of its texts
            a, b = forest(node[i], node[j])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    met = stash(docs.mapInArrow(send, "sig long, node long, n long, sure byte, sketch binary")
                .repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(meet, "a long, b long, sig long, n long, sketch binary"), "signatures")
    asked = (met.where("sig is not null").select("sig", "a")
             .join(met.where("n is not null and a is not null").select("a", "n", "sketch"), "a").select("sig", "a", "n", "sketch"))
    tied = asked.repartition("sig").sortWithinPartitions("sig", "n", "a").mapInArrow(compare, "a long, b long")
    edges = stash(met.where("b is not null").select("a", "b").unionByName(tied).distinct(), "ties")
    coarse = stash(components(edges), "coarse")
    # rows of one id are links of each other where their text meets another in a signature
    repeats = stash(met.where("n is not null and a is not null").groupBy("a").count().where("count > 1").select("a"), "repeats")
    if repeats.limit(1).count():
        lone = met.where("sig is not null").select("a").join(repeats, "a", "left_semi").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
        coarse = stash(coarse.unionByName(lone.join(coarse, "node", "left_anti")), "coarse")
    small = broadcast_up_to(coarse.withColumnRenamed("node", "doc_id"), MEMBERS_BROADCAST)
    members = docs.where("doc_id is not null").join(small, "doc_id")
    amounts = members.groupBy("root").agg(F.sum(F.char_length("text") + 1).alias("chars"))
    split = stash(amounts.where(F.col("chars") > group_chars)
                  .select("root", F.ceil(2 * F.col("chars") / group_chars).cast("int").alias("blocks")), "split")
    any_split = split.limit(1).count() > 0
    if any_split:
        # block pairs (i, j), i <= j; a text of block k goes to all pairs with k
        members = members.join(broadcast_up_to(split, MEMBERS_BROADCAST), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        members = (members.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), "blocks").cast("int"))
                   .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                   .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    else:
        members = members.withColumn("block", F.lit(0)).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))

    def search(batches):
        key, nodes, texts, sides = None, [], [], []

        def close():
            cross = key[1] != key[2]
            roots, links = link_group(nodes, texts, np.array(sides) if cross else None, words, similarity)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64()), pa.array(links, pa.int64()),
                                               pa.array([key[1]] * len(nodes), pa.int32()), pa.array([key[2]] * len(nodes), pa.int32())],
                                              ["node", "root", "links", "i", "j"])

        for batch in batches:
            for root, i, j, block, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (root, i, j):
                    if nodes:
                        yield close()
                    key, nodes, texts, sides = (root, i, j), [], [], []
                nodes.append(doc)
                texts.append(text)
                sides.append(int(block != i))
        if nodes:
            yield close()
        release_memory()

    linked = stash(members.select("root", "i", "j", "block", "doc_id", "text").repartition("root", "i", "j")
                   .sortWithinPartitions("root", "i", "j", "doc_id")
                   .mapInArrow(search, "node long, root long, links long, i int, j int"), "linked")
    # rows of one id share a node; a task's root is final unless its group was split
    result = linked.groupBy("node", "i", "j").agg(F.min("root").alias("root"), F.max("links").alias("links"))
    result = result.groupBy("node").agg(F.min("root").alias("root"), F.sum("links").alias("links"))
    if any_split:
        joined = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
        result = result.drop("root").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = met.where("n is not null").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"))
    return (rows.join(result.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links")))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a),
k AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(k.k, 0) AS n_links
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
