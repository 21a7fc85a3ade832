"""MinHash near-duplicates by a chosen-path set similarity join.

A document is a row's id and text; its set is that of its distinct five-word shingles. One pass over the texts leaves a
fixed number of minwise tokens for each set. Equal sets are merged first; what follows handles one representative, with
a number of its own, for each distinct set.

Every independent tree starts as one node that branches by three coordinates of the tree; trees share no coordinate.
A small node is compared exhaustively on the full sets, in one task, which returns a forest of links. All documents of a
larger one are compared with its centre; if they are in several components then, it branches into four children by four
coordinates each, which the node's own path selects, without the centre, whose comparisons are done. Two sets at the threshold survive 1.27 of the
four branches on average; sets far below it leave 0.25 at similarity 0.5. A node loses its centre at every level, so
branching ends by itself: nothing is capped or dropped. Trees run in groups; links are merged after every level, and
nodes of one component are closed, so that later groups only see what is still apart.

Compared with a centre means: the minwise tokens estimate the similarity, and pairs that are far below the threshold stop there
(chance of losing a true pair below 1e-6); the others are confirmed on the full sets, first the likeliest partner of each
document, then those whose documents are not linked by then.

Recall of a pair at similarity exactly 0.75: trees without crowded nodes miss it with chance (1 - 0.75^3)^24 = 2e-6; if
all its nodes are crowded and mixed, one level deep 7e-5, two levels deep 3e-4. At 0.8 these are 3e-8, 7e-7 and 2e-6.

Tables are written in the work folder and removed when the next one stands on its own.

Defined results: each row has its result row, exact repeats too. Null or empty texts have no shingles, are linked with
nothing and are their own component; fewer than five words are one shingle; rows with equal sets are linked. Rows that
share an id and differ in text are judged apart. ``component_id`` has the type of the id; it is the smallest id of the
component, null if none of its rows has one. ``kept`` marks one row for each component: the smallest id (null last), of
texts under one id the smallest text key, of exact repeats one. Rows without shingles are all kept. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.spread import spread_join
from tidegauge.llm.common import ID, Scratch, append, lean, map_texts, mix, shingle_hashes, text_key, text_of, token_hashes

SHINGLE = 5
PERCENT = 75
COORDINATES = 72
TREES = 24
#: Trees that run together; links are merged between groups. The first group finds nearly all links.
GROUPS = ((0, 8), (8, TREES))
#: Coordinates of a tree's first level, and children and coordinates of each deeper one.
START = 3
CHILDREN = 4
DEEPER = 4
SMALL = 1000
#: Up to so many likely pairs are confirmed in one step.
FEW_PAIRS = 20_000
#: The components of up to so many links are found in one task.
FEW = 200_000
#: Rows of a small step that one task takes, about, and full sets of small nodes; a step never has fewer tasks than run at once.
TASK_ROWS = 20_000
TASK_SETS = 2_000
#: Ids that are broadcast to pick texts out of the documents; with more, documents are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Joins of more rows than this deal heavy keys to parts; Spark broadcasts the other side of smaller ones.
MANY = 500_000
#: Equal coordinates of 72 that a pair needs to be confirmed; a true pair at the threshold has 54 on average.
AGREE = 35

_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of the hash functions, 32 bits of each."""
    out = (shingles[:1024] * _SEEDS[:, None]).min(axis=1)
    for at in range(1024, len(shingles), 1024):
        np.minimum(out, (shingles[at : at + 1024] * _SEEDS[:, None]).min(axis=1), out=out)
    return (mix(out) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, fp1, fp2, sig): set size, two fingerprints of the set, minwise tokens. One pass over the texts."""

    def run(texts: list) -> dict:
        n, f1, f2, sig = [], [], [], []
        for t in texts:
            s = shingle_hashes(token_hashes(t or ""), SHINGLE)
            n.append(len(s))
            f1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            f2.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else 0)
            sig.append(minwise(s) if len(s) else None)
        return {"n": n, "fp1": f1, "fp2": f2, "sig": sig}

    return append(lean(docs, ID, "text").withColumn("key", text_key()), run, "n long, fp1 long, fp2 long, sig array<int>").drop("text")


def _looked_up(rows: DataFrame, lookup: DataFrame, on: str, how: str = "inner", n: int | None = None) -> DataFrame:
    """``rows`` joined with a table of one row per key; the rows of heavy keys are dealt to parts if there are many.

    ``n``: the number of rows, if it is known.
    """
    return spread_join(rows, lookup, [on], how) if (rows.count() if n is None else n) > MANY else rows.join(lookup, on, how)


def _first_nodes(sets: DataFrame, first: int, end: int) -> DataFrame:
    """(node, a) of the trees from ``first`` to before ``end``."""
    own = lambda r: F.xxhash64(F.lit("tree"), r, *[F.element_at("sig", (r * START + i + 1).cast("int")) for i in range(START)])
    trees = F.sequence(F.lit(first), F.lit(end - 1))
    return sets.select("a", F.explode(F.transform(trees, own)).alias("node"))


def _children(rows: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """(node, a) of the children of crowded nodes."""
    def child(k: int):
        at = [F.pmod(F.xxhash64("node", F.lit(level), F.lit(k), F.lit(i)), F.lit(COORDINATES)) for i in range(DEEPER)]
        return F.xxhash64("node", F.lit(level), F.lit(k), *[F.element_at("sig", (c + 1).cast("int")) for c in at])

    nodes = F.array(*[child(k) for k in range(CHILDREN)])
    return rows.select("node", "a").join(sets.select("a", "sig"), "a").select("a", F.explode(nodes).alias("node"))


def _labelled(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``rows`` with the component c of a; without any link so far it is a itself."""
    if comp is None:
        return rows.withColumn("c", F.col("a"))
    return rows.join(comp, "a", "left").withColumn("c", F.coalesce("c", "a"))


def _mixed(rows: DataFrame, n: int) -> DataFrame:
    """(node, a, c, size, centre) of nodes with documents of several components; ``rows`` has node, a and c.

    ``n`` is a bound of the number of rows; of many, those of heavy nodes are dealt to parts. Fewer meet once, by node.

    The centre is the smallest number after mixing it with the node's own key, so that a document is not the centre of
    all the nodes it is in.
    """
    own = F.col("a").bitwiseXOR(F.col("node"))
    if n <= MANY:
        node = Window.partitionBy("node")
        centre = F.min(own).over(node).bitwiseXOR(F.col("node"))
        wide = rows.select("node", "a", "c", F.count("*").over(node).alias("size"), centre.alias("centre"), F.min("c").over(node).alias("lo"), F.max("c").over(node).alias("hi"))
        return wide.filter("lo != hi").drop("lo", "hi")
    nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min(own).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi")
    nodes = nodes.select("node", "n", F.col("n").alias("size"), F.col("m").bitwiseXOR(F.col("node")).alias("centre"))
    return spread_join(rows, nodes.drop("n"), ["node"], counts=nodes.select("node", "n"))


def _node_links(a: np.ndarray, c: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of a node that reach the threshold on their full sets and join what was still apart: a forest of them."""
    order = np.lexsort((a, [len(s) for s in sets]))
    a, sets = a[order], [sets[i] for i in order]
    label = np.unique(c[order], return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = count[shingle] > 1
    at = np.concatenate([[0], np.cumsum(np.add.reduceat(shared, np.cumsum(size) - size, dtype=np.int64))])
    shingle = shingle[shared]
    mark = np.zeros(len(count), dtype=bool)
    last = np.searchsorted(size, size * 100 // PERCENT, side="right")
    links = []
    for i in range(len(a) - 1):
        hi = last[i]
        if (label[i + 1 : hi] == label[i]).all():
            continue
        own = shingle[at[i] : at[i + 1]]
        mark[own] = True
        found = np.concatenate([[0], np.cumsum(mark[shingle[at[i + 1] : at[hi]]])])
        mark[own] = False
        both = np.diff(found[at[i + 1 : hi + 1] - at[i + 1]])
        for j in i + 1 + np.flatnonzero(100 * both >= PERCENT * (size[i] + size[i + 1 : hi] - both)):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((a[i], a[j]))
    return links


def _within(batches):
    """(a, b): the links of nodes whose rows (node, a, c, s) follow each other."""
    kept: list = []

    def of(rows: list) -> list:
        node, a, c, s = (np.concatenate([r[k] for r in rows]) if k < 3 else [x for r in rows for x in r[k]] for k in range(4))
        cuts = [0, *(np.flatnonzero(np.diff(node)) + 1), len(node)]
        return [p for lo, hi in zip(cuts, cuts[1:]) for p in _node_links(a[lo:hi], c[lo:hi], s[lo:hi])]

    for b in batches:
        node, a, c = (np.asarray(b[k]) for k in ("node", "a", "c"))
        s = [np.frombuffer(x, dtype=np.uint64) for x in b["s"].to_pylist()]
        if not len(node):
            continue
        # the last node may go on in the next batch
        cut = int(np.searchsorted(node, node[-1]))
        done = []
        if kept and (cut or node[0] != kept[-1][0][-1]):
            done, kept = of([*kept, (node[:cut], a[:cut], c[:cut], s[:cut])]), []
        elif cut:
            done = of([(node[:cut], a[:cut], c[:cut], s[:cut])])
        kept.append((node[cut:], a[cut:], c[cut:], s[cut:]))
        yield {"a": [p for p, _ in done], "b": [q for _, q in done]}
    if kept:
        done = of(kept)
        yield {"a": [p for p, _ in done], "b": [q for _, q in done]}


def _united(batches):
    """(a, c): the smallest number reachable from each end of a few links (a, b), all in one task."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for b in batches:
        for p, q in zip(b["a"].to_pylist(), b["b"].to_pylist()):
            x, y = root(above.setdefault(p, p)), root(above.setdefault(q, q))
            above[max(x, y)] = min(x, y)
    yield {"a": list(above), "c": [root(x) for x in above]}


def components(links: DataFrame, work: Scratch, n: int) -> tuple[DataFrame, DataFrame]:
    """(a, c): the smallest number reachable from each end of the ``n`` links (a, b); and the written table that holds it.

    Few links are united in one task, as most steps have few and rounds over small tables take longer than their rows.
    Of more, each round takes the smallest label of the neighbours and then the label of that label. Tables are written, so that
    neither the plan nor a lost executor makes a round run twice.
    """
    if n <= FEW:
        few = work.put(map_texts(links.select("a", "b").repartition(1), _united, "a long, c long"), "united")
        return few, few
    edges = work.put(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = work.put(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")), "labels")
    while True:
        near = _looked_up(edges, labels.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b", n=2 * n).groupBy("a").agg(F.min("cb").alias("m"))
        lower = work.put(labels.join(near, "a").select("a", "c", F.least("c", "m").alias("d")), "lower")
        jump = labels.select(F.col("a").alias("d"), F.col("c").alias("e"))
        new = work.put(_looked_up(lower, jump, "d", "left", n=2 * n).select("a", F.least("d", F.coalesce("e", "d")).alias("c"), F.col("c").alias("was")), "labels")
        work.drop(labels, lower)
        if new.filter("c != was").isEmpty():
            work.drop(edges)
            return new.select("a", "c"), new
        labels = new


class _Join:
    """The state of one join: representatives, their full sets as far as they were needed, and components so far."""

    def __init__(self, docs: DataFrame, sets: DataFrame, work: Scratch):
        self.docs, self.sets, self.work = docs, sets, work
        self.size, most = sets.agg(F.count("*"), F.max("copies")).first()
        self.repeats = (most or 1) > 1
        self.full: DataFrame | None = None
        self.comp: DataFrame | None = None

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        """(a, b, same) of pairs that can reach the threshold by their sizes and are not far below it by their tokens."""
        pairs = self.work.put(pairs.distinct(), "pairs")
        x = self.sets.select("a", F.col("n").alias("na"), F.col("sig").alias("sa"))
        y = self.sets.select(F.col("a").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        same = F.aggregate(F.zip_with("sa", "sb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda acc, v: acc + v)
        fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT
        n = self.work.count(pairs)
        # a few rows go to the sets, which stay where they are
        half = F.broadcast(y.join(F.broadcast(pairs), "b")) if n <= FEW_PAIRS else _looked_up(pairs, y, "b", n=n)
        both = half.join(x, "a").filter(fits).select("a", "b", same.alias("same")).filter(F.col("same") >= AGREE)
        likely = self.work.put(both, "likely")
        self.work.drop(pairs)
        return likely

    def load(self, wanted: DataFrame, n: int) -> None:
        """Make the full sets of the at most ``n`` numbers a from their whole texts, but for those that are there already."""
        wanted = wanted.distinct()
        if self.full is not None:
            wanted = wanted.join(self.full.select("a"), "a", "left_anti")
        wanted = self.sets.select("a", F.col(ID).alias("__id"), F.col("key").alias("__key")).join(wanted, "a")

        def run(batches):
            for b in batches:
                yield {"a": b["a"], "s": [shingle_hashes(token_hashes(t or ""), SHINGLE).tobytes() for t in b["text"].to_pylist()]}

        few = F.broadcast(wanted) if n <= MAX_BROADCAST else wanted
        rows = lean(self.docs, ID, "text").withColumn("key", text_key())
        texts = rows.join(few, F.col(ID).eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))).select("a", text_of().alias("text"))
        if self.repeats:
            texts = texts.dropDuplicates(["a"]).coalesce(self.tasks(n, TASK_SETS))
        part = self.work.put(map_texts(texts, run, "a long, s binary"), "full")
        self.full = part if self.full is None else self.full.unionByName(part)

    def confirm(self, pairs: DataFrame, n: int) -> None:
        """Merge the components of the ``n`` pairs whose full sets reach the threshold: 100 * intersection >= 75 * union."""
        def run(batches):
            for b in batches:
                keep = []
                for p, q in zip(b["s"].to_pylist(), b["t"].to_pylist()):
                    x, y = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
                hit = np.flatnonzero(keep)
                yield {"a": b["a"].take(hit), "b": b["b"].take(hit)}

        if n == 0:
            return
        self.load(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))), 2 * n)
        there = _looked_up(pairs.select("a", "b"), self.full.select(F.col("a").alias("b"), F.col("s").alias("t")), "b", n=n)
        links = self.work.put(map_texts(there.join(self.full, "a").select("a", "b", "s", "t"), run, "a long, b long"), "links")
        found = self.work.count(links)
        if found:
            self.merge(links, found)
        self.work.drop(links)

    def merge(self, links: DataFrame, n: int) -> None:
        """Add ``n`` links to the components: the graph of this step has one vertex for each component so far.

        Few links and components are united in one task, where a component is the links to its smallest number.
        """
        if n + (0 if self.comp is None else self.work.count(self.comp)) <= FEW:
            links = links.select("a", "b")
            both = links if self.comp is None else links.unionByName(self.comp.select("a", F.col("c").alias("b")))
            comp = self.work.put(map_texts(both.coalesce(1), _united, "a long, c long"), "components")
            self.work.drop(self.comp)
            self.comp = comp
            return
        ends = links.select("a").unionByName(links.select(F.col("b").alias("a"))).distinct()
        base = ends.withColumn("c", F.col("a"))
        if self.comp is not None:
            base = self.comp.unionByName(base.join(self.comp.select("a"), "a", "left_anti"))
        base = self.work.put(base, "base")
        one = _looked_up(links, base.select(F.col("a").alias("b"), F.col("c").alias("d")), "b", n=n).join(base, "a")
        found, written = components(one.select(F.col("c").alias("a"), F.col("d").alias("b")), self.work, n)
        raised = found.select(F.col("a").alias("c"), F.col("c").alias("e"))
        comp = self.work.put(_looked_up(base, raised, "c", "left", n=self.work.count(base)).select("a", F.coalesce("e", "c").alias("c")), "components")
        self.work.drop(base, written, self.comp)
        self.comp = comp

    def apart(self, pairs: DataFrame, n: int) -> DataFrame:
        """Those of at most ``n`` pairs whose ends are in different components."""
        if self.comp is None:
            return pairs
        other = self.comp.select(F.col("a").alias("b"), F.col("c").alias("d"))
        named = _labelled(_looked_up(pairs, other, "b", "left", n=n), self.comp)
        return named.filter(F.col("c") != F.coalesce("d", "b")).drop("c", "d")

    def compare(self, pairs: DataFrame) -> None:
        """Link the pairs: of many first the likeliest partner of each document, then whatever is still apart."""
        likely = self.agreeing(pairs)
        n = self.work.count(likely)
        if n > FEW_PAIRS:
            best = self.work.put(likely.groupBy("a").agg(F.max_by("b", F.struct("same", "b")).alias("b")), "best")
            self.confirm(best, n)
            rest = self.work.put(self.apart(likely, n).join(best, ["a", "b"], "left_anti"), "rest")
            self.work.drop(likely, best)
            likely, n = rest, self.work.count(rest)
        self.confirm(likely, n)
        self.work.drop(likely)

    def within(self, rows: DataFrame, n: int) -> None:
        """Compare all documents of small nodes on their full sets; ``rows`` (node, a, c) are at most ``n``."""
        self.load(rows.select("a"), n)
        there = rows.select("node", "a", "c").join(self.full, "a").select("node", "a", "c", "s")
        there = there.repartition("node").coalesce(self.tasks(n, TASK_SETS)).sortWithinPartitions("node")
        links = map_texts(there, _within, "a long, b long")
        # trees may find a link again, which only matters to many
        links = self.work.put(links if n <= MANY else links.distinct(), "links")
        found = self.work.count(links)
        if found:
            self.merge(links, found)
        self.work.drop(links)

    def tasks(self, n: int, each: int) -> int:
        """Tasks for ``n`` rows of a small step; its time is else that of starting one for each shuffle partition."""
        return max(self.docs.sparkSession.sparkContext.defaultParallelism, -(-n // each))

    def mixed(self, rows: DataFrame, n: int, name: str) -> tuple[DataFrame, int]:
        """The table of ``_mixed`` nodes of the at most ``n`` rows (node, a), and its number of rows in crowded nodes.

        Many rows are written before they are read for their nodes and again by these, so that none is made twice.
        """
        rows, seen = _labelled(rows, self.comp), Observation()
        crowded = F.count(F.when(F.col("size") > SMALL, True)).alias("crowded")
        members = self.work.put(rows, "members") if n > MANY else None
        found = _mixed(rows if members is None else members, n)
        found = found.coalesce(self.tasks(n, TASK_ROWS)) if members is None else found
        table = self.work.put(found.observe(seen, crowded), name)
        self.work.drop(members)
        many = seen.get.get("crowded")
        return table, table.filter(F.col("size") > SMALL).count() if many is None else many

    def run_trees(self, first: int, end: int) -> None:
        """One group of trees, level by level, until no node has documents of several components."""
        rows, many = self.mixed(_first_nodes(self.sets, first, end), self.size * (end - first), "nodes")
        level = 0
        while n := self.work.count(rows):
            self.within(rows.filter(F.col("size") <= SMALL), n)
            if not many:
                break
            others = rows.filter((F.col("size") > SMALL) & (F.col("a") != F.col("centre")))
            self.compare(self.apart(others.select("a", F.col("centre").alias("b")), n))
            # a centre has met all others of its node, so what is left of a node are those others
            left, _ = self.mixed(others.select("node", "a"), n, "left")
            self.work.drop(rows)
            level += 1
            children = _children(left.filter(F.col("size") > SMALL), self.sets, level)
            small = left.filter(F.col("size") <= SMALL).select("a", "node")
            rows, many = self.mixed(children.unionByName(small), self.work.count(left) * CHILDREN, "nodes")
            self.work.drop(left)
        self.work.drop(rows)


def _classified(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, copies, component_id, kept): one row for each id and text. kept: the row that stands for its component."""
    work = Scratch(docs.sparkSession, "near-duplicates")
    sketch = work.put(sketches(docs), "sketches")
    rows = work.put(sketch.groupBy(ID, "key").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "fp1", "fp2")]), "rows")
    rank = F.struct(F.col(ID).isNull().alias("none"), F.col(ID).alias("id"), F.col("key").alias("k"))
    same = sketch.filter("n > 0").groupBy("n", "fp1", "fp2").agg(F.min(rank).alias("r"), F.first("sig").alias("sig"))
    own = same.select("n", "fp1", "fp2", F.col("r.id").alias(ID), F.col("r.k").alias("key"), "sig")
    # numbers are fixed by the written table
    sets = work.put(own.withColumn("a", F.monotonically_increasing_id()), "sets")
    repeats = rows.filter("copies > 1").select(F.col(ID).alias("__id"), F.col("key").alias("__k"), "copies")
    named = sets.join(repeats, F.col(ID).eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__k")), "left")
    join = _Join(docs, named.select("a", ID, "key", "n", "sig", F.coalesce("copies", F.lit(1)).alias("copies")), work)
    for first, end in GROUPS:
        join.run_trees(first, end)
    # a set's own rank is in its row, so the smallest row of a component needs no other look at the documents
    marked = _labelled(sets.select("a", "n", "fp1", "fp2", rank.alias("r")), join.comp)
    least = marked.groupBy("c").agg(F.min("r").alias("least"))
    of_set = work.put(_looked_up(marked.select("n", "fp1", "fp2", "c"), least, "c", n=join.size).select("n", "fp1", "fp2", "least"), "classes")
    # one set may be that of a third of all rows
    joined = spread_join(rows.withColumnRenamed("n", "words"), of_set.withColumnRenamed("n", "words"), ["words", "fp1", "fp2"], "left").withColumnRenamed("words", "n")
    component = F.when(F.col("n") == 0, F.col(ID)).otherwise(F.col("least.id"))
    kept = F.when(F.col("n") == 0, True).otherwise(F.col(ID).eqNullSafe(F.col("least.id")) & (F.col("key") == F.col("least.k")))
    done = work.put(joined.select(ID, "key", "n", "copies", component.alias("component_id"), kept.alias("kept")), "result")
    work.drop_all(but=done)
    return done


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = _classified(docs).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("kept") & ((F.col("copy") == 1) | (F.col("n") == 0))
    return rows.select(ID, F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, as ``kept`` says; columns as they came. Of exact repeats any one stays."""
    rows = _classified(docs)
    found = lambda which: F.broadcast(which) if which.count() <= MAX_BROADCAST else which
    names = lambda which: which.select(F.col(ID).alias("__id"), F.col("key").alias("__k"))
    on = F.col(f"`{ID}`").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__k"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__text_key", text_key())
    left = keyed.join(found(names(rows.filter(~F.col("kept")))), on, "left_anti")
    repeated = names(rows.filter("kept and copies > 1 and n > 0"))
    if not repeated.isEmpty():
        once = left.join(found(repeated), on, "left_semi").dropDuplicates([ID, "__text_key"])
        left = left.join(found(repeated), on, "left_anti").unionByName(once)
    return left.select(*columns)
