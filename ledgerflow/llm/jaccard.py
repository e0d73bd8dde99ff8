"""N-gram Jaccard join: near duplicates by rare-first prefix filtering.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Documents with equal sets form a class with one node. The shingles of a node are
ordered rare first (by a sketch of BUCKETS counters over all documents), and its
prefix is so long that two sets of the asked similarity share a prefix shingle.
Nodes that share one stand in a list; candidates of a list pass a length filter,
a positional filter (what can still follow behind the shingle) and a suffix
filter (an upper bound of the overlap from 256 counts of the two whole sets).
Candidates are verified on the whole sets, once per pair.

Sets travel as hashes: of 64 bits up to SMALL shingles, of 40 up to LONG, and of
48 beyond. Hashes that fall together can only add to what two sets seem to have
in common, so a pair that has too little is none. A pair of shortened hashes that
has MARGIN more than it needs is one, as so many chance agreements in a pair come
once in 10**28. Pairs in between are decided on the words of their texts. A node
is named by 64 bits; should two different sets, told apart by 64 further bits,
share a name, all are named anew.

Only the components of the links are asked for, so pairs that are connected
already are left out, and no group of near copies costs its square: in the first
round each node meets its neighbour in a list under some of ORDERS random
orders. After every round the links so far are turned into components, and later
rounds take pairs of lists whose nodes are in different components and which
pass the filters: first only the likeliest pairs that join the nodes of a piece
and the next one (a maximum spanning forest, by the bound of the suffix filter),
then those of all pieces that meet, as long as many of them are links, then WIDER
such forests, then every pair that is left. Where links are many, the forests
find enough of them to make one component, so that the last rounds are left with
pairs that are no links. They leave out no link between components. Lists are dealt out in pieces of at most PIECE nodes of
about the same size, pairs of pieces apart, so no task holds a whole list. Pieces
whose sizes are too far apart don't meet, nor do pieces in which all nodes are in
one and the same component. The rows of shingles that the sketch finds far more
often than others are numbered in several lots, by a hash of the node.

Defined results: null texts and texts without words have no shingles and are
linked with nothing. A text of one to four words has one shingle, the whole
sequence. Rows without an id count as documents, but lend no id to a component.
Repeated ids are documents of their own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ledgerflow.llm import text as X
from ledgerflow.llm.components import components
from ledgerflow.runtime import Scratch, cut, drop

SHINGLE = 5
BUCKETS = 1 << 18
#: Bits of a token below the class of its counter.
LOW = 58
BINS = 256
SMALL, LONG = 64, 2048
#: Shingles in common beyond what is needed, from which shortened hashes are trusted.
MARGIN = 4
ORDERS = 16
#: Bytes of text that are turned into shingles at once.
SLICE = 1 << 20
PIECE = 256
#: Forests of pairs that nodes of different components try before all pairs are taken.
WIDER = 16
#: If one in so many pairs that were tried is a link, single forests go on.
FRUITFUL = 4
#: Whole logarithm of the count from which on a shingle's rows are numbered in lots, where it is CROWD more than usual.
HOT, CROWD = 16, 4
#: Nodes that are asked for are told apart by so many residues before their sets are dealt out: a bound for what is broadcast.
RESIDUES = 1 << 20


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, int]:
    """Text index and hash of every distinct shingle, in that order, and the number of texts."""
    data, at = X.utf8(column)
    words = X.Words(data, at, X.SPACED)
    hashes, text = words.hashes(), words.text
    gram = X.windows(hashes, size)
    inside = text[size - 1 :] == text[: len(gram)] if len(gram) else np.zeros(0, bool)
    text, gram = text[: len(gram)][inside], gram[inside]
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(few):
        whole = words.count[few].astype(np.uint64)
        for k in range(size - 1):
            more = words.count[few] > k
            whole[more] = X.mix(whole[more] * np.uint64(0xD6E8FEB86659FD93) + hashes[words.first[few[more]] + k])
        text, gram = np.append(text, few), np.append(gram, whole)
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
    return text[new], gram[new], len(at) - 1


#: What tells the two numbers of a set apart.
NAME, CHECK = 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25


def _nodes(gram: np.ndarray, first: np.ndarray, salt: int = NAME) -> np.ndarray:
    """A number for each set, from its elements only."""
    total = np.zeros(len(gram) + 1, np.uint64)
    np.cumsum(X.mix(gram ^ np.uint64(salt)), out=total[1:])
    return X.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _unseen(nodes: np.ndarray, checks: np.ndarray, filled: np.ndarray, seen: set[tuple[int, int]]) -> np.ndarray:
    """The first row of each set that this task has not met."""
    fresh = np.zeros(len(nodes), bool)
    for k in np.flatnonzero(filled):
        if (v := (int(nodes[k]), int(checks[k]))) not in seen:
            seen.add(v)
            fresh[k] = True
    return fresh


def _bucket(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def count_classes(source: DataFrame) -> np.ndarray:
    """For each counter of the sketch, the whole logarithm of its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(BUCKETS, np.int64), set()
        for batch in X.slices(batches, "text", SLICE):
            text, gram, n = shingles(batch.column(0))
            first = np.searchsorted(text, np.arange(n + 1))
            fresh = _unseen(_nodes(gram, first), _nodes(gram, first, CHECK), np.diff(first) > 0, seen)
            counts += np.bincount(_bucket(gram[fresh[text]]), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], names=["bucket", "n"])

    # at most BUCKETS rows, whatever the input
    sums = source.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    classes = np.zeros(BUCKETS, np.uint8)
    classes[sums["bucket"].to_numpy(np.int64)] = np.floor(np.log2(np.maximum(sums["n"].to_numpy(float), 1)))
    return classes


def _packed(gram: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each set's sorted hashes, whole up to SMALL, the upper 5 bytes of each up to LONG, else 6."""
    raw = gram.byteswap().view(np.uint8).reshape(-1, 8)
    five, six = np.ascontiguousarray(raw[:, :5]), np.ascontiguousarray(raw[:, :6])
    return [(raw if b - a <= SMALL else five if b - a <= LONG else six)[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]


def _width(n1: int, n2: int) -> int:
    """Bytes of the hashes that both sets of a pair have."""
    return 8 if max(n1, n2) <= SMALL else 6 if min(n1, n2) > LONG else 5


def _opened(data: bytes, n: int, width: int) -> np.ndarray:
    """The packed hashes, ascending; those that are the same in so many bytes once."""
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8).reshape(n, -1)[:, :width]
    sorted_ = raw.view(np.uint64).ravel().byteswap()
    new = np.ones(n, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return sorted_[new]


def describe(source: DataFrame, classes: np.ndarray, num: int, den: int) -> DataFrame:
    """Per document: key, node, check, n; in one row of each node and task also prefix, bins and set."""
    held = source.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = held.value.astype(np.uint64) << np.uint64(LOW), set()
        for batch in X.slices(batches, "text", SLICE):
            text, gram, n = shingles(batch.column(1))
            first = np.searchsorted(text, np.arange(n + 1))
            size = np.diff(first)
            nodes, checks = _nodes(gram, first), _nodes(gram, first, CHECK)
            fresh = _unseen(nodes, checks, size > 0, seen)
            sets = _packed(gram, first)
            token = rank[_bucket(gram)] | (gram & np.uint64((1 << LOW) - 1))
            own = fresh[text]
            bins = np.zeros((n, BINS), np.int64)
            np.add.at(bins, (text[own], (gram[own] >> np.uint64(20)).astype(np.int64) % BINS), 1)
            bins = np.minimum(bins, 255).astype(np.uint8)
            order = np.lexsort((token[own], text[own]))
            t, token = text[own][order], token[own][order]
            begin = np.searchsorted(t, np.arange(n + 1))
            # a partner shares ceil(num / den * size) shingles at least
            most = size - (num * size + den - 1) // den + 1
            keep = np.arange(len(t)) - begin[t] < most[t]
            at = np.zeros(n + 1, np.int32)
            np.cumsum(np.where(fresh, most, 0), out=at[1:])
            prefix = pa.ListArray.from_arrays(pa.array(at, mask=np.append(~fresh, False)), pa.array(token[keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, mask=size == 0), pa.array(checks), pa.array(size, pa.int64()), prefix, pa.array([b.tobytes() if f else None for b, f in zip(bins, fresh)], pa.binary()), pa.array([s if f else None for s, f in zip(sets, fresh)], pa.binary())],
                names=["key", "node", "check", "n", "prefix", "bins", "set"],
            )

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, node long, check long, n long, prefix array<long>, bins binary, set binary")


class Ground:
    """What a join stands on: source (key, text), rows (of describe()), and members, the least key of each node."""

    def __init__(self, source: DataFrame, rows: DataFrame):
        self.source, self.rows, self.renamed = source, rows, 0
        while True:
            self.members = cut(self.rows.filter("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.min("check").alias("low"), F.max("check").alias("high")), "jaccard-members")
            if self.members.filter("low <> high").isEmpty():
                break
            # different sets share a name
            again = cut(self.rows.withColumn("node", self.new_name()), "jaccard-rows")
            drop(source.sparkSession, self.rows, self.members)
            self.rows, self.renamed = again, self.renamed + 1
        self.nodes = self.rows.filter("prefix IS NOT NULL")

    @staticmethod
    def new_name() -> Column:
        return F.when(F.col("node").isNotNull(), F.xxhash64("node", "check"))

    def texts(self, wanted: DataFrame) -> DataFrame:
        """node and text, one for each of the wanted nodes and few others."""
        # only documents whose keys may be those of such nodes, told by a residue, are looked at
        residue = F.pmod(F.xxhash64("key"), F.lit(RESIDUES)).cast("int")
        keys = asked(self.nodes.select("key", "node"), wanted).select(residue.alias("residue")).distinct()
        near = self.source.withColumn("residue", residue).join(F.broadcast(keys), "residue", "left_semi").select("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for batch in X.slices(batches, "text", SLICE):
                text, gram, n = shingles(batch.column(0))
                first = np.searchsorted(text, np.arange(n + 1))
                nodes, checks = _nodes(gram, first), _nodes(gram, first, CHECK)
                fresh = pa.array(_unseen(nodes, checks, np.diff(first) > 0, seen))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(checks), batch.column(0)], names=["node", "check", "text"]).filter(fresh)

        found = near.mapInArrow(run, "node long, check long, text string")
        for _ in range(self.renamed):
            found = found.withColumn("node", self.new_name())
        return asked(found, wanted).groupBy("node").agg(F.first("text").alias("text"))


def _lots(classes: np.ndarray) -> Column:
    """In how many lots the rows of a token are numbered."""
    usual = int(np.median(classes[classes > 0])) if classes.any() else 0
    over = f"CAST(shiftrightunsigned(token, {LOW}) AS INT) - {max(usual + CROWD, HOT) - 1}"
    return F.expr(f"shiftleft(1L, greatest(0, {over}))")


def _numbered(size: int):
    """Of rows sorted by token, lot, place and node: those whose token has several nodes or lots, with the number of the list's piece of `size` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "node", "place", "piece"]
        held = np.zeros((5, 0), np.int64)  # the last row, until the next token is known
        held_shared, index = False, 0  # whether it is in its list already, and its number in the list

        def piece(rows: np.ndarray, number: np.ndarray) -> pa.Array:
            return pa.array(number // size * rows[4] + rows[3])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])], axis=1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            rows = rows[:, new]
            n = rows.shape[1]
            start = np.ones(n, bool)
            start[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[3, 1:] != rows[3, :-1])
            begin = np.maximum.accumulate(np.where(start, np.arange(n), 0))
            number = np.arange(n) - begin + np.where(begin == 0, index, 0)
            # a list in lots may have its other nodes elsewhere
            shared = ~start | (rows[4] > 1)
            shared[0] |= held_shared
            shared[:-1] |= ~start[1:]
            out = np.flatnonzero(shared[:-1])
            if len(out):
                yield pa.RecordBatch.from_arrays([*(pa.array(rows[k, out]) for k in range(3)), piece(rows[:, out], number[out])], names=names)
            held, held_shared, index = rows[:, -1:], bool(shared[-1]), int(number[-1])
        if held.shape[1] and held_shared:
            yield pa.RecordBatch.from_arrays([*(pa.array(held[k]) for k in range(3)), piece(held, np.array([index]))], names=names)

    return run


def spanning(a: np.ndarray, b: np.ndarray, n: int, forests: int) -> np.ndarray:
    """Which of the edges (a, b) of n nodes, best first, are in one of so many spanning forests, each of the best edges that are in none before."""
    taken = np.zeros(len(a), bool)
    for _ in range(forests):
        live, root = np.flatnonzero(~taken), np.arange(n)
        if not len(live):
            break
        while True:
            x, y = root[a[live]], root[b[live]]
            apart = x != y
            live, x, y = live[apart], x[apart], y[apart]
            if not len(live):
                break
            # each tree takes its best edge and hangs itself on the tree at the other end
            best = np.full(n, len(live))
            np.minimum.at(best, x, np.arange(len(live)))
            np.minimum.at(best, y, np.arange(len(live)))
            trees = np.flatnonzero(best < len(live))
            edge = best[trees]
            taken[live[edge]] = True
            up = np.arange(n)
            up[trees] = x[edge] + y[edge] - trees
            # two trees that have taken the same edge: the lesser one stays
            up = np.where((up[up] == np.arange(n)) & (up > np.arange(n)), np.arange(n), up)
            while (up[up] != up).any():
                up = up[up]
            root = up[root]
    return taken


class Join:
    """The join of one collection, for a similarity of `percent` / 100."""

    def __init__(self, percent: int):
        self.percent, self.whole, self.margin = percent, 100 + percent, MARGIN

    def common(self, total):
        """The least intersection of two sets of `total` elements together."""
        return (self.percent * total + self.whole - 1) // self.whole

    def fits(self, n1, p1, n2, p2):
        """Length and positional filters: sizes, and places of the shared shingle, counted from 0; n1 <= n2."""
        enough = self.percent * n2 <= 100 * n1
        # the smaller one's part of the prefix that partners not smaller can meet
        early = p1 <= n1 - self.common(2 * n1)
        return enough & early & (n1 - p1 >= self.common(n1 + n2)) & (n2 - p2 >= self.common(n1 + n2))

    def first_round(self, lists: DataFrame) -> DataFrame:
        """Pairs of neighbours in the pieces of lists, under some random orders."""
        turn = W.partitionBy("token", "piece").orderBy(F.xxhash64("node", F.pmod("token", F.lit(ORDERS))), "node")
        n, p = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
        met = lists.withColumn("n", n).withColumn("p", p).withColumn("other", F.lag(F.struct("n", "p", "node")).over(turn)).filter("other IS NOT NULL")
        me, other = F.struct("n", "p", "node"), F.col("other")
        small, large = F.least(me, other), F.greatest(me, other)
        met = met.select(small.alias("s"), large.alias("l")).select("s.n", "s.p", F.col("s.node").alias("x"), F.col("l.n").alias("n2"), F.col("l.p").alias("p2"), F.col("l.node").alias("y"))
        total, twice = F.col("n") + F.col("n2"), F.col("n") * 2
        least = lambda c: F.ceil(c * self.percent / self.whole - 1e-9)
        ok = (F.col("n2") * self.percent <= F.col("n") * 100) & (F.col("p") <= F.col("n") - least(twice)) & (F.col("n") - F.col("p") >= least(total)) & (F.col("n2") - F.col("p2") >= least(total))
        return met.filter(ok).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

    def later_rounds(self, lists: DataFrame, ground: Ground, labels: DataFrame) -> DataFrame:
        """The components once all links between those of labels are known; lists and labels are dropped."""
        spark = lists.sparkSession
        with Scratch(spark) as held:
            left = held.cut(self.unsettled(lists, labels), "jaccard-left")
            drop(spark, lists)
            bins = ground.nodes.filter("bins IS NOT NULL").select("node", "bins")
            bins = held.cut(asked(bins, left.select("node")).groupBy("node").agg(F.first("bins").alias("bins")), "jaccard-bins")
            tried, close, forests = None, True, 1
            while True:
                meets = held.cut(self.meetings(left, close), "jaccard-meets")
                found = held.cut(self.pairs_of(left.join(meets, ["token", "piece"]), bins, forests), "jaccard-found")
                held.drop(meets)
                pairs = found.select("x", "y").distinct()
                pairs = held.cut(pairs.join(tried, ["x", "y"], "left_anti") if tried else pairs, "jaccard-second")
                tries, links = pairs.count(), 0
                if tries:
                    more = self.verified(pairs, ground, bound=False)
                    links = more.count()
                    if links:
                        before, labels = labels, components(labels.union(more))
                        drop(spark, before)
                    drop(spark, more)
                # pairs that wait, or pieces that have not met yet
                waiting = found.filter("more").select("token")
                if close:
                    waiting = waiting.union(left.groupBy("token").agg((F.max("piece") - F.min("piece")).alias("far")).filter("far > 1").select("token"))
                if forests is None or waiting.isEmpty():
                    return labels
                before, left = left, held.cut(self.unsettled(left.join(waiting.distinct(), "token", "left_semi"), labels), "jaccard-left")
                tried = held.cut(tried.union(pairs), "jaccard-tried") if tried else pairs
                held.drop(before, found)
                # while many pairs are links, those of a forest more leave fewer to try
                if not links or FRUITFUL * links < tries:
                    forests = WIDER if forests == 1 else None
                close = False

    def unsettled(self, lists: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of lists that have nodes of several components, with these as label."""
        known = lists.join(labels, lists.node == labels.u, "left").select("token", "node", "place", "piece", F.coalesce("v", "node").alias("label"))
        tokens = known.groupBy("token").agg(F.count("*").alias("many"), F.min("label").alias("a"), F.max("label").alias("b"), F.min("piece").alias("first"), F.max("piece").alias("last"))
        # in a list of two the pair has been met, if they were in one piece
        return known.join(tokens.filter("(many > 2 OR first < last) AND a < b").select("token"), "token")

    def meetings(self, left: DataFrame, close: bool = False) -> DataFrame:
        """Which pieces i <= j of a list meet, in a row for each of the two (token, piece, i, j); `close`: only pieces that follow each other.

        Pieces whose nodes all have the label that most such pieces of the list
        have need not meet each other, so pairs are only made with the others.
        """
        n = F.shiftright("place", 32)
        pieces = left.groupBy("token", "piece").agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.min("label").alias("a"), F.max("label").alias("b"))
        most = pieces.filter("a = b").groupBy("token", "a").agg(F.count("*").alias("many")).groupBy("token").agg(F.max_by("a", F.struct("many", "a")).alias("most"))
        mixed = pieces.join(most, "token", "left").filter("a < b OR NOT a <=> most").select("token", F.col("piece").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        near = (F.greatest("lo", "lo2") * self.percent <= F.least("hi", "hi2") * 100) & (F.least("a", "a2") < F.greatest("b", "b2"))
        if close:
            mixed = mixed.withColumn("piece", F.explode(F.array(*(F.col("other") + k for k in (-1, 0, 1)))))
        met = pieces.join(mixed, ["token", "piece"] if close else "token").filter(near).select("token", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j")).distinct()
        return met.select("token", F.explode(F.array_distinct(F.array("i", "j"))).alias("piece"), "i", "j")

    def pairs_of(self, left: DataFrame, bins: DataFrame, forests: int | None = None) -> DataFrame:
        """Pairs (x, y) of a token that pass the filters, or so many forests of them; more: whether others of their list wait."""
        dealt = left.join(bins, "node").select("token", "i", "j", "piece", "node", "place", "label", "bins")
        dealt = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "node")

        def pairs(rows: list[np.ndarray], bins: np.ndarray) -> tuple[np.ndarray, ...]:
            token, i, j, piece, node, place, label = rows
            a, b = np.triu_indices(len(node), 1)
            keep = label[a] != label[b]
            if i[0] != j[0]:
                keep &= piece[a] != piece[b]
            a, b = a[keep], b[keep]
            n, p = place >> 32, place & 0xFFFFFFFF
            swap = n[a] > n[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            keep = self.fits(n[a], p[a], n[b], p[b])
            a, b = a[keep], b[keep]
            total = n[a] + n[b]
            most = np.concatenate([self.most(bins[a[k : k + 20000]], bins[b[k : k + 20000]], total[k : k + 20000]) for k in range(0, len(a), 20000)] or [np.zeros(0, np.int64)])
            keep = most >= self.common(total)
            a, b, total, most = a[keep], b[keep], total[keep], most[keep]
            x, y = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            taken = np.ones(len(a), bool)
            if forests is not None:
                order = np.lexsort((y, x, -most / total))
                taken[order] = spanning(a[order], b[order], len(node), forests)
            return np.full(taken.sum(), token[0]), x[taken], y[taken], np.full(taken.sum(), not taken.all())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: pa.Table | None = None
            for batch in batches:
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
                yield from emit(held, last=False)
                keys = [held.column(k).to_numpy() for k in range(3)]
                change = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])) + 1
                # a group has two pieces at most, so what is kept is bounded
                held = held.slice(int(change[-1])) if len(change) else held
            if held is not None:
                yield from emit(held, last=True)

        def emit(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            rows = [table.column(k).to_numpy() for k in range(7)]
            change = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])) + 1
            ends = [0, *change.tolist()] + ([len(rows[0])] if last else [])
            if len(ends) < 2:
                return
            bins = np.frombuffer(b"".join(table.column(7).slice(0, ends[-1]).to_pylist()), np.uint8).reshape(-1, BINS)
            found = [pairs([r[a:b] for r in rows], bins[a:b]) for a, b in zip(ends[:-1], ends[1:]) if b - a > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(4)], names=["token", "x", "y", "more"])

        return dealt.mapInArrow(run, "token long, x long, y long, more boolean")

    def most(self, bins1: np.ndarray, bins2: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Suffix filter: how much the sets, by their counts, can have in common at most."""
        full = (bins1 == 255).any(axis=1) | (bins2 == 255).any(axis=1)
        return np.where(full, total, np.minimum(bins1, bins2).sum(axis=1, dtype=np.int64))

    def verified(self, pairs: DataFrame, ground: Ground, bound: bool) -> DataFrame:
        """The pairs (x, y) of nodes that are similar, as edges (u, v); written."""
        nodes = ground.nodes
        with Scratch(pairs.sparkSession) as held:
            if bound:
                bins = held.cut(asked(nodes.select("node", "n", "bins"), ends(pairs)).groupBy("node").agg(F.first("n").alias("n"), F.first("bins").alias("bins")), "jaccard-bins")
                pairs = held.cut(_both(pairs, bins, "n", "bins").mapInArrow(self._bound, "x long, y long"), "jaccard-pairs")
                held.drop(bins)
            sets = held.cut(asked(nodes.select("node", "n", "set"), ends(pairs)).groupBy("node").agg(F.first("n").alias("n"), F.first("set").alias("set")), "jaccard-sets")
            judged = held.cut(_both(pairs, sets, "n", "set").mapInArrow(self._similar, "u long, v long, sure boolean"), "jaccard-judged")
            held.drop(sets)
            edges, unsure = judged.filter("sure").select("u", "v"), judged.filter("NOT sure").select(F.col("u").alias("x"), F.col("v").alias("y"))
            if not unsure.isEmpty():
                texts = held.cut(ground.texts(ends(unsure)), "jaccard-texts")
                edges = edges.union(_both(unsure, texts, "text").mapInArrow(self._same_words, "u long, v long"))
            return cut(edges, "jaccard-edges")

    def _bound(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n1, n2 = (batch.column(k).to_numpy() for k in range(4))
            bins = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (4, 5)]
            keep = self.most(*bins, n1 + n2) >= self.common(n1 + n2)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], names=["x", "y"])

    def _similar(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that have enough in common by their hashes, and whether that is sure."""
        for batch in batches:
            u, v, sure = [], [], []
            for x, y, n1, n2, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                width = _width(n1, n2)
                one, two = _opened(a, n1, width), _opened(b, n2, width)
                common, need = len(np.intersect1d(one, two, assume_unique=True)), self.common(n1 + n2)
                # what falls together in both sets is counted once
                if common + min(n1 - len(one), n2 - len(two)) >= need:
                    u.append(x)
                    v.append(y)
                    sure.append(bool(width == 8 or common >= need + self.margin))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sure, pa.bool_())], names=["u", "v", "sure"])

    def _same_words(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                one, two = word_shingles(a), word_shingles(b)
                keep.append(100 * len(one & two) >= self.percent * len(one | two))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def word_shingles(text: str, size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    # bytes are split where words `[^\x20\x09-\x0D]+` are
    words = text.encode("utf-8", "surrogatepass").translate(X.LOWER.tobytes()).split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("node"))


def asked(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of nodes that can be among the wanted ones, told by a residue: at most RESIDUES are broadcast."""
    residue = F.pmod(F.col("node"), F.lit(RESIDUES)).cast("int")
    return nodes.withColumn("residue", residue).join(F.broadcast(wanted.select(residue.alias("residue")).distinct()), "residue", "left_semi").drop("residue")


def _both(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """x, y, and each of the columns for x and then y."""
    left = nodes.select(F.col("node").alias("x"), *(F.col(c).alias(f"{c}1") for c in columns))
    right = nodes.select(F.col("node").alias("y"), *(F.col(c).alias(f"{c}2") for c in columns))
    return pairs.join(left, "x").join(right, "y").select("x", "y", *(f"{c}{k}" for c in columns for k in (1, 2)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """Per document: key, n_shingles and component (the least key reachable by links)."""
    spark = docs.sparkSession
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    join = Join(percent)
    classes = count_classes(source)
    ground = Ground(source, cut(describe(source, classes, percent, 100), "jaccard-rows"))
    rows, members = ground.rows, ground.members

    with Scratch(spark) as held:
        place = F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long"))
        postings = ground.nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "node", place.alias("place"), _lots(classes).alias("lots"))
        postings = postings.select("token", "node", "place", F.pmod(F.xxhash64("node"), "lots").alias("lot"), "lots")
        lists = held.cut(postings.repartition("token", "lot").sortWithinPartitions("token", "lot", "place", "node").mapInArrow(_numbered(PIECE), "token long, node long, place long, piece long"), "jaccard-lists")

        met = held.cut(join.first_round(lists), "jaccard-first")
        edges = join.verified(met, ground, bound=True)
        held.drop(met)
        labels = components(edges)
        held.drop(edges)
        labels = join.later_rounds(lists, ground, labels)

    with Scratch(spark) as held:
        # nodes that no link leads to are components by themselves
        classes = held.cut(members.join(labels, members.node == labels.u, "left").select("node", "key", F.coalesce("v", "node").alias("label")), "jaccard-classes")
        named = held.cut(classes.groupBy("label").agg(F.min("key").alias("component")), "jaccard-named")
        final = held.cut(classes.select("node", "label").join(named, "label").select("node", "component"), "jaccard-classes")
        held.drop(members, labels, classes, named)
        out = cut(rows.filter("n > 0").select("key", "node", "n").join(final, "node").select("key", F.col("n").alias("n_shingles"), "component"), "jaccard-out")
    alone = cut(rows.filter("n = 0").select("key", F.col("n").alias("n_shingles"), F.col("key").alias("component")), "jaccard-out")
    drop(spark, rows)
    return out.union(alone)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The documents without their near duplicates: of each component the row of the least id; of rows equal in all columns one."""
    row = X.free_name(docs.columns, "row_hash")
    hashed = F.xxhash64(*(docs[c] for c in docs.columns))
    found = near_duplicates(docs.select(F.struct(docs[key].alias("id"), hashed.alias("row")).alias("key"), docs[text].alias("text")), "key", "text", percent)
    stay = cut(found.filter("key <=> component").groupBy("key").agg(F.count("*").alias("many")).select("key.id", "key.row", "many"), "jaccard-stay")
    marked = docs.withColumn(row, hashed)
    on = lambda few: (marked[row] == few["row"]) & marked[key].eqNullSafe(few["id"])
    if stay.filter("many > 1").isEmpty():
        return marked.join(stay, on(stay), "left_semi").select(*docs.columns)
    once, again = stay.filter("many = 1"), stay.filter("many > 1")
    return marked.join(once, on(once), "left_semi").select(*docs.columns).union(marked.join(again, on(again), "left_semi").dropDuplicates([key, row]).select(*docs.columns))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(X.table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (SELECT x, y FROM p JOIN n AS nx ON x = nx.doc_id JOIN n AS ny ON y = ny.doc_id WHERE 100 * i >= 80 * (nx.n + ny.n - i)
), r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), c AS (SELECT x, min(y) AS component FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON d.doc_id = c.x
"""
