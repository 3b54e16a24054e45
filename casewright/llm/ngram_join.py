"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its 5-word shingles, as 64-bit hashes; documents with one and the same set are one node.
A node's shingles are also hashed into groups, and the counts of its groups are its point: for two nodes
``sum(min(p_i, q_i))`` bounds the size of their intersection, and the same sum with a tree node's largest
coordinates bounds it for everything below that tree node.

1. Which nodes meet at all is decided by prefixes: with shingles in one global order, two sets of Jaccard similarity t
   share one of their first ``n - ceil(t * n) + 1``.  The order puts frequent shingles (of passages that many documents
   hold) last, so they seldom are in a prefix.
2. The nodes of one prefix shingle are named after the smallest of them, and those of one name are a group: near copies
   share dozens of prefix shingles, but only a few names.  Every pair that shares a prefix shingle is in some group.
3. In each group an R-tree over the points finds the nodes whose bound with another one suffices for a link; what the
   bound connects goes on, all else is done.
4. Those few groups get their texts and are verified on full sets.  A group is a task's own union-find: a pair is only
   compared while its two nodes are in different components, so a task gives back at most one link for each node.
5. Links are joined into components.

A group of more than ``CHUNK`` nodes (or ``CHUNK_SHINGLES`` in all) is cut by hash into chunks which run 3 and 4 on
their own; then only the nodes outside the group's largest component are held against the other chunks.  So memory is
bounded and no link between components is lost, while a huge group of copies that hang together costs what its rows do.
Nothing is capped or sampled; counts that set the order only choose among equally correct orders.

Defined results: null and word-less texts have no shingles and are linked with nothing; a null doc_id never is a
component_id unless all ids of a component are null; repeated rows are linked like copies; ties cannot matter, as
components do not depend on an order; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators.components import components
from casewright.llm.shingles import set_key, shingle_sets
from casewright.session import cut

#: Links need 100 * intersection >= NUMERATOR * union.
NUMERATOR = 75
HOT, MAX_HOT = 32, 200_000
#: Prefix shingles met in more rows than this are not gathered by key: their smallest node is found by partial sums.
SPREAD = 1 << 15
CHUNK, CHUNK_SHINGLES, LEAF, SMALL = 2048, 1 << 22, 32, 64
SLICE = 1 << 20
#: Shingles are counted in runs of so many: those that a run has once are not counted, so the longer the run the rarer
#: is what still counts as frequent.
COUNTED = 1 << 22
#: Prefixes travel packed: a row of their shuffle has what a slice of them holds of one of so many shares of all shingles.
SHARES = 1024
BROADCAST_ROWS = 500_000


def needed(total: np.ndarray | int, numerator: int = NUMERATOR):
    """Smallest intersection that links two sets of ``total`` shingles together: 100 i >= s (total - i)."""
    return -(-numerator * total // (100 + numerator))


def prefix_length(n: int, numerator: int = NUMERATOR) -> int:
    return n - -(-numerator * n // 100) + 1


def points(hashes: np.ndarray) -> np.ndarray:
    """Counts of the groups (a power of two of them, a quarter to a half as many as shingles), as bytes."""
    groups = 1 << max(4, (len(hashes) // 4 - 1).bit_length())
    while True:
        counts = np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        groups *= 2


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The same node's point over fewer groups."""
    return point.reshape(-1, groups).sum(axis=0, dtype=np.uint16) if len(point) > groups else point


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def bound(p: np.ndarray, q: np.ndarray) -> int:
    """Largest possible intersection of the sets behind two points."""
    groups = min(len(p), len(q))
    return int(np.minimum(folded(p, groups), folded(q, groups)).sum(dtype=np.int64))


class CountTree:
    """Packed R-tree over points with equally many groups: levels of boxes over leaves of ``LEAF`` points.

    Points are packed in order of size, then of their coarse counts; a box keeps its largest coordinates and its
    sizes' range.
    """

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.order = np.argsort(sizes, kind="stable")
        if len(rows) > 2 * leaf:
            coarse = rows.reshape(len(rows), -1, min(8, rows.shape[1])).sum(axis=1)
            self.order = np.lexsort((*coarse.T[::-1], sizes))
        self.rows, self.sizes, self.leaf = rows[self.order], sizes[self.order], leaf
        self.levels = []
        box, low, high = self.rows, self.sizes, self.sizes
        while len(box) > 2 * leaf:
            cuts = np.arange(0, len(box), leaf)
            box = np.maximum.reduceat(box, cuts, axis=0)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((box, low, high))

    def search(self, q: np.ndarray, size: int, numerator: int = NUMERATOR) -> np.ndarray:
        """Positions (of the given rows) whose bound with ``q`` suffices for a link."""
        at = None
        for box, low, high in reversed(self.levels):
            at = np.arange(len(box)) if at is None else self._below(at, len(box))
            at = at[(numerator * low[at] <= 100 * size) & (numerator * size <= 100 * high[at])]
            at = at[np.minimum(box[at], q).sum(axis=1, dtype=np.int64) >= needed(size + low[at], numerator)]
            if not len(at):
                return at
        if at is None:
            lo, hi = np.searchsorted(self.sizes, [-(-numerator * size // 100), 100 * size // numerator + 1])
            at = np.arange(lo, hi)
        else:
            at = self._below(at, len(self.rows))
            at = at[(numerator * self.sizes[at] <= 100 * size) & (numerator * size <= 100 * self.sizes[at])]
        at = at[np.minimum(self.rows[at], q).sum(axis=1, dtype=np.int64) >= needed(size + self.sizes[at], numerator)]
        return self.order[at]

    def _below(self, at: np.ndarray, n: int) -> np.ndarray:
        out = (at[:, None] * self.leaf + np.arange(self.leaf)).ravel()
        return out[out < n]


def clusters(label: np.ndarray, probe: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Labels after joining what ``near`` finds; pairs need a member of ``probe`` (a mask), and differing labels.

    ``near(k, at)`` gives those of the positions ``at`` that k is joined with.  A pair is only looked at while its two
    ends differ, so a group that hangs together takes few looks.
    """
    label = np.unique(label, return_inverse=True)[1]
    todo, open_ = probe.copy(), np.ones(len(label), bool)  # to be looked from; not yet looked from
    while todo.any():
        counts = np.bincount(label[open_])
        most = counts.argmax()
        if counts[most] == open_.sum():
            break  # all pairs that were not looked at are within one component
        at = np.flatnonzero(todo & (label != most))
        k = at[0] if len(at) else np.flatnonzero(todo)[0]
        todo[k] = open_[k] = False
        found = near(k, np.flatnonzero(open_ & (label != label[k])))
        if len(found):
            label[np.isin(label, label[found])] = label[k]
    return label


def in_groups(key: list[str], handle: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | None]):
    """A task over rows sorted by ``key``: ``handle`` gets rows of whole keys and the places where keys start."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last key's rows so far: they may go on in the next batch

        def cuts(rows: pd.DataFrame) -> np.ndarray:
            columns = [rows[c].to_numpy() for c in key]
            new = np.zeros(len(rows), bool)
            new[:1] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            return np.flatnonzero(new)

        def done(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
            out = handle(rows, np.r_[cuts(rows), len(rows)]) if len(rows) else None
            if out is not None and len(out):
                yield out

        for b in batches:
            if not len(b):
                continue
            last = cuts(b)[-1]
            if last:  # a key ends in this batch
                yield from done([*held, b.iloc[:last]])
                held = []
            elif held and any(held[0][c].iat[0] != b[c].iat[0] for c in key):
                yield from done(held)
                held = []
            held.append(b.iloc[last:])
        if held:
            yield from done(held)

    return task


def pairs_within(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: the places of all pairs within the runs between ``starts`` (the last of which is the end)."""
    n = starts[-1]
    after = np.repeat(starts[1:], np.diff(starts)) - np.arange(n) - 1  # places after each one in its run
    i = np.repeat(np.arange(n), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    return i, j


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


# --- stages ------------------------------------------------------------------------------------------------------


def frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and their counts, sorted: they are put last in the order (any order is correct)."""

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        sets, size, seen = [], 0, set()
        for b in batches:
            fresh = {key: text for key, text in zip(map(hash, b.text), b.text, strict=True) if key not in seen}
            seen.update(fresh)  # copies are one node, so they don't make a shingle frequent
            for s in shingle_sets(fresh.values(), words):
                sets.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield np.concatenate(sets)
                    sets, size = [], 0
        if size:
            yield np.concatenate(sets)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for values in slices(batches):
            values.sort()
            starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            counts = np.diff(np.r_[starts, len(values)])
            some = counts >= 2
            yield pd.DataFrame({"token": values[starts[some]].view(np.int64), "n": counts[some].astype(np.int64)})

    totals = texts.mapInPandas(task, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    top = totals.orderBy(F.desc("n"), "token").limit(MAX_HOT).toPandas()  # MAX_HOT rows at most
    token = top.token.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top.n.to_numpy(np.int64)[order]


def nodes_of(texts: DataFrame, words: int, numerator: int, held) -> DataFrame:
    """For each row: doc_id, tk, n, node; and tokens (its prefix) and point where its task first meets the node."""

    def prefix(s: np.ndarray, maybe: np.ndarray) -> np.ndarray:
        token, count = held.value
        size = prefix_length(len(s), numerator)
        at = np.flatnonzero(maybe[(s & np.uint64(len(maybe) - 1)).astype(np.int64)])  # the others are not frequent
        if not len(at):
            return s[:size]
        place = np.minimum(np.searchsorted(token, s[at]), len(token) - 1)
        is_ = token[place] == s[at]
        at, place = at[is_], place[is_]
        rare = np.delete(s, at)[:size]
        return np.r_[rare, s[at[np.argsort(count[place], kind="stable")[: size - len(rare)]]]]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        maybe = np.zeros(1 << 22, bool)  # by a hash's last bits: whether it may be frequent
        maybe[(held.value[0] & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
        known: dict[int, tuple[int, int | None]] = {}  # of each text: its copies are not shingled again
        for b in batches:
            fresh = {tk: text for tk, text in zip(b.tk, b.text, strict=True) if tk not in known}
            made = {}
            for tk, s in zip(fresh, shingle_sets(fresh.values(), words), strict=True):
                node = set_key(s) if len(s) else None
                known[tk] = len(s), node
                if len(s) and node not in seen:
                    seen.add(node)
                    made[tk] = prefix(s, maybe).tobytes(), points(s).tobytes()
            out = [(doc_id, tk, *known[tk], *made.pop(tk, (None, None))) for doc_id, tk in zip(b.doc_id, b.tk, strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "tk", "n", "node", "tokens", "point"], dtype=object)

    return texts.mapInPandas(task, "doc_id long, tk long, n long, node long, tokens binary, point binary")


def groups_of(prefixes: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(g, node): the nodes of each prefix shingle that several have, under the smallest of them; from (node, tokens)."""
    token, count = hot
    wide = token[count >= SPREAD]

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(token, node) of all prefixes, about ``SLICE`` at once."""
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def done() -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([t for _, t in held]), np.repeat(np.array([n for n, _ in held], np.int64), [len(t) for _, t in held])

        for b in batches:
            for node, tokens in zip(b.node, b.tokens, strict=True):
                held.append((node, np.frombuffer(tokens, np.uint64)))
                size += len(held[-1][1])
                if size >= SLICE:
                    yield done()
                    held, size = [], 0
        if size:
            yield done()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens, nodes in slices(batches):
            if len(wide):
                narrow = ~np.isin(tokens, wide)
                tokens, nodes = tokens[narrow], nodes[narrow]
            share = (tokens & np.uint64(SHARES - 1)).astype(np.uint16)  # last bits: prefixes have mostly small shingles
            order = np.argsort(share, kind="stable")
            tokens, nodes = tokens[order], nodes[order]
            cuts = np.searchsorted(share[order], np.arange(1, SHARES))
            runs = [(r, lo, hi) for r, (lo, hi) in enumerate(zip(np.r_[0, cuts], np.r_[cuts, len(tokens)], strict=True)) if lo < hi]
            yield pd.DataFrame([(r, tokens[lo:hi].tobytes(), nodes[lo:hi].tobytes()) for r, lo, hi in runs], columns=["r", "tokens", "nodes"])

    def named(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(tokens)
        tokens, nodes = tokens[order], nodes[order]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        g = np.repeat(np.minimum.reduceat(nodes, starts), np.diff(np.r_[starts, len(tokens)]))
        other = g != nodes
        names = np.unique(g[other])
        return np.r_[g[other], names], np.r_[nodes[other], names]

    def handle(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        tokens, nodes = rows.tokens.to_numpy(), rows.nodes.to_numpy()
        found = [named(np.frombuffer(b"".join(tokens[lo:hi]), np.uint64), np.frombuffer(b"".join(nodes[lo:hi]), np.int64)) for lo, hi in zip(starts[:-1], starts[1:], strict=True)]
        return pd.DataFrame({"g": np.concatenate([g for g, _ in found]), "node": np.concatenate([n for _, n in found])}).drop_duplicates()

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens, nodes in slices(batches):
            at = np.flatnonzero(np.isin(tokens, wide))
            yield pd.DataFrame({"token": tokens[at].view(np.int64), "node": nodes[at]})

    dealt = prefixes.mapInPandas(pack, "r int, tokens binary, nodes binary").repartition("r").sortWithinPartitions("r")
    found = dealt.mapInPandas(in_groups(["r"], handle), "g long, node long")
    if len(wide):  # at most MAX_HOT tokens
        many = prefixes.mapInPandas(some, "token long, node long")
        smallest = many.groupBy("token").agg(F.min("node").alias("g"))
        found = found.unionAll(many.join(F.broadcast(smallest), "token").select("g", "node"))
    return cut(found.distinct())


def connected(rows: DataFrame, numerator: int) -> DataFrame:
    """(g, h, part, node, label, role) of the nodes that the trees' bounds connect with another one of (g, h).

    ``rows``: g, h, node, label, role (0 stays in this chunk, 1 visits it, 2 is looked from), n, point.
    """

    def near_pairs(size: np.ndarray, point: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (i, j) whose bound suffices."""
        fit = (numerator * size[i] <= 100 * size[j]) & (numerator * size[j] <= 100 * size[i])
        i, j = i[fit], j[fit]
        groups = np.array([len(p) for p in point])
        fewer = np.minimum(groups[i], groups[j])
        keep = np.zeros(len(i), bool)
        for g in np.unique(fewer):  # over the fewer groups of both: a larger point is folded
            at = np.flatnonzero(fewer == g)
            used = np.unique(np.r_[i[at], j[at]])
            place = np.zeros(len(size), np.int64)
            place[used] = np.arange(len(used))
            m = np.stack([folded(point[k], g) for k in used]).astype(np.uint16)
            for lo in range(0, len(at), step := max(1, SLICE // int(g))):
                part = at[lo : lo + step]
                both = np.minimum(m[place[i[part]]], m[place[j[part]]]).sum(axis=1, dtype=np.int64)
                keep[part] = both >= needed(size[i[part]] + size[j[part]], numerator)
        return i[keep], j[keep]

    def tree_parts(size: np.ndarray, point: list[np.ndarray], label: np.ndarray, role: np.ndarray) -> np.ndarray:
        """What the bounds connect in one large group."""
        groups = np.array([len(p) for p in point])
        trees = {}
        for g in np.unique(groups):
            at = np.flatnonzero(groups == g)
            trees[g] = (at, CountTree(np.stack([point[k] for k in at]).astype(np.uint16), size[at]))

        def near(k: int, at: np.ndarray) -> np.ndarray:
            out = []
            for g, (places, tree) in trees.items():
                if g <= groups[k]:
                    out.append(places[tree.search(folded(point[k], g).astype(np.uint16), int(size[k]), numerator)])
                else:
                    fit = np.intersect1d(places, at)
                    out.append(near_pairs(size, point, np.full(len(fit), k), fit)[1])
            return np.intersect1d(np.concatenate(out), at)

        return clusters(label, role > 0, near)

    def handle(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame | None:
        size, label, role = (rows[c].to_numpy() for c in ("n", "label", "role"))
        point = [np.frombuffer(p, np.uint8) for p in rows.point]
        part = np.zeros(len(rows), np.int64)
        length = np.diff(starts)
        small = length <= SMALL
        at = np.flatnonzero(np.repeat(small, length))  # rows of small groups: all their pairs at once
        i, j = (at[x] for x in pairs_within(np.r_[0, np.cumsum(length[small])]))
        some = (label[i] != label[j]) & ((role[i] > 0) | (role[j] > 0))
        i, j = near_pairs(size, point, i[some], j[some])
        part[:] = joined(len(rows), i, j)
        for lo, hi in zip(starts[:-1][~small], starts[1:][~small], strict=True):
            part[lo:hi] = lo + tree_parts(size[lo:hi], point[lo:hi], label[lo:hi], role[lo:hi])
        order = np.lexsort((label, part))
        differs = np.flatnonzero((part[order][1:] == part[order][:-1]) & (label[order][1:] != label[order][:-1]))
        keep = np.isin(part, part[order][differs])  # parts of several labels
        return rows[["g", "h", "node", "label", "role"]].assign(part=part)[keep]

    dealt = rows.repartition("g", "h").sortWithinPartitions("g", "h")
    return dealt.mapInPandas(in_groups(["g", "h"], handle), "g long, h int, part long, node long, label long, role int")


def verified(rows: DataFrame, words: int, numerator: int) -> DataFrame:
    """(a, b): links between labels that join what full sets connect, from g, h, part, node, label, role, text."""

    def star(node: np.ndarray, label: np.ndarray, role: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Links (a, b) of one part's labels: the smallest of each cluster, and each other one."""
        node, at = np.unique(node, return_index=True)
        label, role = label[at], role[at]
        sets = list(shingle_sets([texts[k] for k in at], words))
        size = np.array([len(s) for s in sets])
        held: list[np.ndarray] = []

        def near(k: int, at: np.ndarray) -> np.ndarray:
            at = at[(numerator * size[at] <= 100 * size[k]) & (numerator * size[k] <= 100 * size[at])]
            if len(at) < 8:
                both = np.array([overlap(sets[k], sets[x]) for x in at], np.int64)
            else:  # count the shingles that each one shares with k
                if not held:
                    tokens = np.concatenate(sets)
                    order = np.argsort(tokens, kind="stable")
                    held.extend((tokens[order], np.repeat(np.arange(len(sets)), size)[order]))
                tokens, owner = held
                lo, hi = np.searchsorted(tokens, sets[k], "left"), np.searchsorted(tokens, sets[k], "right")
                both = np.zeros(len(sets), np.int64)
                for a in range(0, len(lo), 1024):  # bounded: at most 1,024 shingles' owners at once
                    x, y = lo[a : a + 1024], hi[a : a + 1024]
                    places = np.repeat(x - np.cumsum(y - x) + (y - x), y - x) + np.arange((y - x).sum())
                    both += np.bincount(owner[places], minlength=len(sets))
                both = both[at]
            return at[100 * both >= numerator * (size[at] + size[k] - both)]

        part = clusters(label, role > 0, near)
        order = np.lexsort((label, part))
        part, label = part[order], label[order]
        first = np.r_[True, part[1:] != part[:-1]]
        smallest = np.repeat(label[first], np.diff(np.r_[np.flatnonzero(first), len(label)]))
        other = smallest != label
        return smallest[other], label[other]

    def handle(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame | None:
        node, label, role, texts = rows.node.to_numpy(), rows.label.to_numpy(), rows.role.to_numpy(), rows.text.to_list()
        out = [star(node[lo:hi], label[lo:hi], role[lo:hi], texts[lo:hi]) for lo, hi in zip(starts[:-1], starts[1:], strict=True)]
        return pd.DataFrame({"a": np.concatenate([a for a, _ in out]), "b": np.concatenate([b for _, b in out])})

    dealt = rows.repartition("g", "h", "part").sortWithinPartitions("g", "h", "part")
    return dealt.mapInPandas(in_groups(["g", "h", "part"], handle), "a long, b long").distinct()


def _texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes (node, doc_id, tk), one text of each."""
    keys = wanted.select("node", F.col("doc_id").alias("id"), F.col("tk").alias("k"))
    keys = F.broadcast(keys) if wanted.count() <= BROADCAST_ROWS else keys
    rows = texts.join(keys, (F.col("tk") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return rows.groupBy("node").agg(F.first("text").alias("text"))


def _links(parts: DataFrame, info: DataFrame, texts: DataFrame, words: int, numerator: int) -> DataFrame:
    """Links within the chunks of ``parts`` (g, h, node, label, role)."""
    near = cut(connected(parts.join(info.select("node", "n", "point"), "node"), numerator))
    # Near copies share several names, so one part may have been met in several groups: it is verified once.
    same = F.struct(F.bit_xor(F.xxhash64("node", "label", "role")).alias("a"), F.bit_xor(F.xxhash64("role", "node", "label", F.lit(1))).alias("b"), F.count(F.lit(1)).alias("k"))
    kinds = near.groupBy("g", "h", "part").agg(same.alias("same")).groupBy("same").agg(F.min(F.struct("g", "h", "part")).alias("first"))
    near = cut(near.join(kinds.select("first.*"), ["g", "h", "part"], "left_semi"))
    wanted = cut(near.select("node").distinct().join(info.select("node", "doc_id", "tk"), "node"))
    return cut(verified(near.join(_texts(texts, wanted), "node"), words, numerator))


def jaccard_join(documents: DataFrame, words: int = 5, numerator: int = NUMERATOR) -> DataFrame:
    """doc_id, n_shingles, component_id, tk (hash of the text), node and label (smallest node of the component) of
    every row.

    Columns doc_id and text are read.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    hot = frequent(texts.select("text"), words)
    held = documents.sparkSession.sparkContext.broadcast(hot)
    rows = cut(nodes_of(texts, words, numerator, held))
    held.destroy()
    first = rows.where("tokens is not null")
    groups = groups_of(first.select("node", "tokens"), hot)
    info = first.join(groups.select("node").distinct(), "node", "left_semi")
    info = info.groupBy("node").agg(F.min(F.struct("doc_id", "tk")).alias("i"), F.first("n").alias("n"), F.first("point").alias("point"))
    info = cut(info.select("node", "i.*", "n", "point"))

    total = groups.join(info.select("node", "n"), "node").groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    chunks = F.ceil(F.greatest(F.col("k") / CHUNK, F.col("n") / CHUNK_SHINGLES)).cast("int")
    large = cut(total.select("g", chunks.alias("chunks")).where("chunks > 1"))
    h = F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int")
    parts = groups.join(large, "g", "left").select("g", h.alias("h"), "node", "chunks")
    # A large group's own name visits all of its chunks, so that they hang together early.
    visits = large.select("g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("h"), F.col("g").alias("node"), "chunks")
    visits = visits.where(F.col("h") != F.pmod(F.xxhash64("node"), F.col("chunks")))
    start = parts.unionAll(visits).select("g", "h", "node", F.col("node").alias("label"), F.lit(2).alias("role"))
    links = _links(start, info, texts, words, numerator)
    labels = components(links)
    if not large.isEmpty():
        marked = parts.where("chunks is not null").join(labels, "node", "left").select("g", "h", "node", "chunks", F.coalesce("label", "node").alias("label"))
        marked = cut(marked)
        most = marked.groupBy("g", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("g").agg(F.max(F.struct("k", "label")).alias("most"), F.count(F.lit(1)).alias("labels"))
        marked = marked.join(most.where("labels > 1").select("g", F.col("most.label").alias("most")), "g")
        others = marked.where("label <> most").select("g", F.col("h").alias("home"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("h"), "node", "label")
        again = marked.select("g", "h", "node", "label", F.lit(0).alias("role")).unionAll(others.where("h <> home").select("g", "h", "node", "label", F.lit(1).alias("role")))
        links = cut(links.unionAll(_links(again, info, texts, words, numerator)))
        labels = components(links)

    named = cut(rows.select("doc_id", "tk", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    # A row that is alone needs no join; the others' labels are broadcast while they are few, so a hot one gathers nowhere.
    smallest = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("k"))
    smallest = cut(smallest.where("k > 1").select("label", "component_id", F.lit(True).alias("several")))
    out = named.join(F.broadcast(smallest) if smallest.count() <= BROADCAST_ROWS else smallest, "label", "left")
    own = F.when(F.col("several"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "tk", "node", "label")


def keep_one(documents: DataFrame, words: int = 5, numerator: int = NUMERATOR) -> DataFrame:
    """``documents`` with one row of each component (smallest doc_id, then hash of the text), all columns kept.

    Components are told apart by their label: a component_id may be null or shared where doc_ids are null or repeated.
    """
    found = cut(jaccard_join(documents, words, numerator).where("node is not null").select("doc_id", "label", "tk"))
    per_text = cut(found.groupBy("label", "doc_id", "tk").agg(F.count(F.lit(1)).alias("k")))
    best = per_text.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("w"), F.sum("k").alias("all"))
    best = cut(best.where(F.col("all") > 1).select("label", "w"))  # a row that is alone stays without a join
    several = per_text.join(F.broadcast(best) if best.count() <= BROADCAST_ROWS else best, "label")
    judged = several.select("doc_id", "tk", "k", (F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("tk") == F.col("w.tk"))).alias("stays"))
    judged = cut(judged.where("not stays or k > 1").select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk"), "stays"))
    n = judged.count()
    side = F.broadcast(judged) if n <= BROADCAST_ROWS else judged
    met = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__tk"))
    out = documents.join(side.drop("stays"), met, "left_anti")
    if judged.where("stays").isEmpty():
        return out
    again = documents.join(F.broadcast(judged.where("stays")) if n <= BROADCAST_ROWS else judged.where("stays"), met).dropDuplicates(["__id", "__tk"])
    return out.unionByName(again.select(*documents.columns))
