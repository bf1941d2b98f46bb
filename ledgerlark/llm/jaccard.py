"""N-gram Jaccard join by vertical partitioning.

The n-grams of all documents have one global order: by hash, those that ``HOT`` documents or more hold (passages and lines
in many documents) after all others. Two sets of at least t similarity share an n-gram among the first n - ceil(t n) + 1
of each in any such order, so these few are sent, and sets that share a sent n-gram are candidates. As frequent n-grams
come last, a set sends them only where at least the share t of it is frequent.

For candidates that go on, the order is cut into ``parts`` fragments; the overlap of a pair is counted in each fragment
separately, and the partial counts are summed per pair and compared with the set sizes.

Nothing is capped or sampled:

* Documents with equal sets form one class, and classes are compared, so copies cost no pairs.
* First each class is compared with the centre that it shares most sent n-grams with. Members of an n-gram that are then in
  one component need no comparison with each other.
* Of the members that are still apart, those with a partner that sizes and counts by bucket don't rule out are compared in
  blocks. A block gives a spanning forest of what it links, so its rows grow with its members, not with their square.

Null and empty texts have no n-grams and link with nothing. Rows with equal ids are handled as separate rows. N-grams and
sets are told apart by 64-bit hashes: two n-grams with one hash would count as the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, connected_components

U = np.uint64
HOT, HOT_KEYS, BLOCK = 32, 1_000_000, 1024


def _fingerprint(s: np.ndarray) -> int:
    both = np.array([tokens.mix(s).sum(dtype=np.uint64)]) * U(3) ^ np.bitwise_xor.reduce(s) ^ U(len(s) * 0x9E3779B1)
    return int(tokens.mix(both).view(np.int64)[0])


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, data, at in tokens.chunks(column):
        yield from tokens.shingle_sets(data, at, k)


def set_classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, print (of the text), n (set size), cls (one value for equal sets), counts (n-grams in each bucket)."""

    def run(batches):
        for batch in batches:
            sizes, classes, counts = [], [], []
            for s in _sets(batch.column("text"), k):
                sizes.append(len(s))
                classes.append(_fingerprint(s) if len(s) else 0)
                counts.append(_bucket_counts(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(counts, pa.binary())], ["doc_id", "print", "n", "cls", "counts"])

    return docs.select("doc_id", F.xxhash64("text").alias("print"), "text").mapInArrow(run, "doc_id long, print long, n long, cls long, counts binary")


def _bucket_counts(s: np.ndarray) -> bytes:
    """The n-grams in each of 16 to 8192 equal ranges of the hashes, about three in each, as 16-bit numbers."""
    if not len(s):
        return b""
    bits = min(13, max(4, (len(s) // 3).bit_length()))
    return np.minimum(np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 65535).astype(np.uint16).tobytes()


def _most_overlap(a: bytes, b: bytes) -> int:
    """The sum over buckets of the smaller count: no overlap can be larger."""
    x, y = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = y.reshape(len(x), -1).sum(axis=1)
    return int(np.minimum(x, y).sum()) if x.max() < 65535 and y.max() < 65535 else 1 << 62


def sent_ngrams(s: np.ndarray, percent: int, hot: np.ndarray) -> np.ndarray:
    """The first n-grams of a sorted set in the global order, one more than a similar set may lack; ``hot`` is sorted.

    A set so small that one n-gram more or less makes it unlike links with no other set and sends nothing.
    """
    n = len(s)
    if 100 * n < percent * (n + 1):
        return s[:0]
    first = n + 1 + (-percent * n) // 100
    if not len(hot):
        return s[:first]
    late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
    return np.concatenate((s[~late], s[late]))[:first]


def _one_of_each(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(class, set) of the sets of a batch; copies in one batch count once."""
    seen = {0}
    for s in _sets(column, k):
        c = _fingerprint(s) if len(s) else 0
        if c not in seen:
            seen.add(c)
            yield c, s


def ngram_counts(docs: DataFrame, k: int) -> DataFrame:
    """key, n: every n-gram with the number of batch-wise distinct sets that hold it."""

    def run(batches):
        for batch in batches:
            held: list[np.ndarray] = []
            size = 0
            for _, s in _one_of_each(batch.column("text"), k):
                held.append(s)
                size += len(s)
                if size > 1 << 21:
                    yield counted(held)
                    held, size = [], 0
            if held:
                yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], ["key", "n"])

    rows = docs.select("text").mapInArrow(run, "key long, n int")
    return rows.repartition("key").groupBy("key").agg(F.sum("n").alias("n"))


def _sent(docs: DataFrame, k: int, percent: int, hot: Broadcast) -> DataFrame:
    """key, cls: the n-grams that each class sends."""

    def run(batches):
        for batch in batches:
            keys, classes = [], []
            for c, s in _one_of_each(batch.column("text"), k):
                keys.append(sent_ngrams(s, percent, hot.value))
                classes.append(c)
                if len(keys) >= 512:
                    yield pairs(keys, classes)
                    keys, classes = [], []
            if keys:
                yield pairs(keys, classes)

    def pairs(keys: list[np.ndarray], classes: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(classes, np.int64), [len(x) for x in keys]))], ["key", "cls"])

    return docs.select("text").mapInArrow(run, "key long, cls long")


def _members(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """key, cls, n: the sent n-grams that n classes share, n at least 2."""
    frequent = scratch.save(ngram_counts(docs, k).where(F.col("n") >= HOT), "frequent")
    limit = max(HOT, (frequent.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    keys = frequent.where(F.col("n") >= limit).select("key").toPandas()["key"].to_numpy(np.int64)  # HOT_KEYS at most
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(keys.view(np.uint64)))
    dealt = _sent(docs, k, percent, hot).repartition("key").distinct()
    shared = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.save(dealt.join(shared, "key"), "members")
    scratch.drop("frequent")
    return members


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes, and then whose counts by bucket, allow the similarity: what is left out cannot link."""
    size = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"))
    counts = lambda c: classes.select(F.col("cls").alias(c), F.col("counts").alias(f"c{c}"))
    near = pairs.join(size("a"), "a").join(size("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    rows = near.join(counts("a"), "a").join(counts("b"), "b").select("a", "b", "na", "nb", "ca", "cb")

    def run(batches):
        for batch in batches:
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            most = np.array([_most_overlap(x, y) for x, y in zip(batch.column("ca").to_pylist(), batch.column("cb").to_pylist(), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * most >= percent * n))

    return rows.mapInArrow(run, "a long, b long")


def _fragments(docs: DataFrame, sets: DataFrame, used: DataFrame, k: int, parts: int) -> DataFrame:
    """cls, parts: for each of the classes ``used(cls)`` its n-grams, cut where the global order of hashes is cut."""
    one = sets.join(used, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("doc_id", "print")).alias("r")).select("cls", "r.doc_id", "r.print")
    both = [docs["doc_id"].eqNullSafe(one["doc_id"]), F.xxhash64("text") == one["print"]]
    text = docs.join(one, both).select("cls", "text").dropDuplicates(["cls"])
    edges = (np.arange(1, parts, dtype=np.uint64) * U(2**64 // parts)).astype(np.uint64)

    def run(batches):
        for batch in batches:
            cut = [[x.tobytes() for x in np.split(s, np.searchsorted(s, edges))] for s in _sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(cut, pa.list_(pa.binary()))], ["cls", "parts"])

    return text.mapInArrow(run, "cls long, parts array<binary>")


def _verified(fragments: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` of classes those that are similar: overlaps are counted by fragment and summed per pair."""
    cut = lambda c: fragments.select(F.col("cls").alias(c), F.posexplode("parts").alias("part", f"p{c}"))
    rows = pairs.join(cut("a"), "a").join(cut("b"), ["b", "part"]).select("a", "b", "part", "pa", "pb")

    def run(batches):
        for batch in batches:
            both = zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)
            o = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in both]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "part")), pa.array(o, pa.int64())], ["a", "b", "part", "o"])

    overlap = rows.mapInArrow(run, "a long, b long, part int, o long").groupBy("a", "b").agg(F.sum("o").alias("o"))
    size = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"))
    return overlap.join(size("a"), "a").join(size("b"), "b").where(f"100 * o >= {percent} * (na + nb - o)").select("a", "b")


def _by_group(dealt: DataFrame, compare, schema: str) -> DataFrame:
    """``compare(table, cuts)`` on runs of whole groups (key, i, j), which ``dealt`` holds sorted in its partitions."""

    def run(batches):
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            keys = np.stack([rest.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if len(cuts):
                yield compare(rest.slice(0, cuts[-1]), np.concatenate(([0], cuts)))
                rest = rest.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield compare(rest, np.array([0, rest.num_rows]))

    return dealt.mapInArrow(run, schema)


def _apart(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """key, i, j, own, cls, comp: members with a partner in another component that may link by sizes and bucket counts.

    ``members(key, cls, comp)``. N-grams with the same members count once. Members are compared in blocks of ``BLOCK``,
    each block with each, so an n-gram that very many share is spread over tasks.
    """
    sums = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("sum")]
    mixed = members.groupBy("key").agg(*sums).where("lo <> hi").groupBy("m", "sum").agg(F.min("key").alias("key"))
    rows = members.join(mixed.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "comp")
    known = spread.join(classes, "cls").select("key", "i", "j", "own", "cls", "comp", "n", "counts")
    dealt = known.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return _by_group(dealt, lambda table, cuts: _with_partner(table, cuts, percent), "key long, i int, j int, own int, cls long, comp long")


class _Group:
    """The members of one group by size: rows of the table, sizes, components, and the rivals that a member may link with."""

    def __init__(self, table: pa.Table, lo: int, hi: int, percent: int):
        part = table.slice(lo, hi - lo)
        n = part.column("n").to_numpy()
        order = np.argsort(n, kind="stable")
        self.rows, self.size = lo + order, n[order]
        self.own, self.cls, self.comp = (part.column(c).to_numpy()[order].copy() for c in ("own", "cls", "comp"))
        self.across = part.column("i")[0].as_py() != part.column("j")[0].as_py()
        self.upto = np.searchsorted(self.size * percent, self.size * 100, "right")  # partners no smaller than the member

    def rivals(self, p: int) -> np.ndarray:
        r = np.arange(p + 1, self.upto[p])
        keep = self.comp[r] != self.comp[p]
        if self.across:
            keep &= self.own[r] != self.own[p]
        return r[keep]


def _with_partner(table: pa.Table, cuts: np.ndarray, percent: int) -> pa.RecordBatch:
    raw = table.column("counts").to_pylist()
    hit = np.zeros(table.num_rows, bool)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        g = _Group(table, lo, hi, percent)
        widths = np.array([len(raw[k]) for k in g.rows])
        flat: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for p in range(len(g.rows) - 1):
            rival = g.rivals(p)
            mine = np.frombuffer(raw[g.rows[p]], np.uint16)
            for w in np.unique(widths[rival]):
                if w not in flat:
                    whose = np.flatnonzero(widths == w)
                    flat[w] = whose, np.frombuffer(b"".join(raw[g.rows[x]] for x in whose), np.uint16).reshape(len(whose), -1)
                whose, counts = flat[w]
                part = rival[widths[rival] == w]
                theirs, own = counts[np.searchsorted(whose, part)], mine
                if theirs.shape[1] > len(mine):
                    theirs = theirs.reshape(len(part), len(mine), -1).sum(axis=2, dtype=np.int64)
                elif theirs.shape[1] < len(mine):
                    own = mine.reshape(theirs.shape[1], -1).sum(axis=1, dtype=np.int64)
                most = np.minimum(theirs, own).sum(axis=1, dtype=np.int64)
                full = (theirs.max(axis=1) >= 65535) | (own.max() >= 65535)
                may = part[full | ((100 + percent) * most >= percent * (g.size[p] + g.size[part]))]
                if len(may):
                    hit[g.rows[p]] = hit[g.rows[may]] = True
    names = ["key", "i", "j", "own", "cls", "comp"]
    return pa.RecordBatch.from_arrays([pa.array(table.column(c).to_numpy()[hit]) for c in names], names)


def _forest(table: pa.Table, cuts: np.ndarray, percent: int) -> pa.RecordBatch:
    """a, b: links of whole sets that join the components of each group, no more than it has components."""
    found: list[tuple[int, int]] = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        g = _Group(table, lo, hi, percent)
        sets = [np.frombuffer(b"".join(table.column("parts")[int(k)].as_py()), np.uint64) for k in g.rows]
        grams, at = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.cumsum(g.size) - g.size
        mark = np.zeros(len(grams), bool)
        for p in range(len(g.rows) - 1):
            rival = g.rivals(p)
            if not len(rival):
                continue
            mine = at[begin[p] : begin[p] + g.size[p]]
            mark[mine] = True
            size = g.size[rival]
            first = np.cumsum(size) - size
            overlap = np.add.reduceat(mark[at[np.repeat(begin[rival] - first, size) + np.arange(size.sum())]], first, dtype=np.int64)
            mark[mine] = False
            near = rival[100 * overlap >= percent * (g.size[p] + size - overlap)]
            comps, one = np.unique(g.comp[near], return_index=True)
            found += [(g.cls[p], g.cls[near[k]]) for k in one]
            g.comp[np.isin(g.comp, comps)] = g.comp[p]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])


def similarity_components(docs: DataFrame, words: int = 5, percent: int = 80, parts: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs(doc_id, text)``; further columns are ignored.

    Rows link when the Jaccard similarity of their sets of ``words``-word shingles is at least ``percent`` / 100;
    component_id is the smallest doc_id reachable by links. ``parts``: fragments that overlaps are counted in.
    """
    return similar_rows(docs, words, percent, parts).select("doc_id", "n_shingles", "component_id")


def similar_rows(docs: DataFrame, words: int = 5, percent: int = 80, parts: int = 8) -> DataFrame:
    """The columns of ``similarity_components``, print (of the text) and comp: one value for each component.

    Components of different texts with one smallest doc_id differ in comp; it is null for rows that link with nothing.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = scratch.save(set_classes(docs, words), "sets")
    classes = scratch.save(sets.where("n > 0").select("cls", "n", "counts").dropDuplicates(["cls"]), "classes")
    reps = sets.select("doc_id", "print", "cls")
    members = _members(docs, words, percent, scratch)
    # The centre of an n-gram is the member whose n-grams are shared most: of near copies, what they are copies of.
    weight = members.groupBy("cls").agg(F.sum("n").alias("weight"))
    centre = members.join(weight, "cls").groupBy("key").agg(F.max(F.struct("weight", "cls")).getField("cls").alias("low"))
    star = members.join(centre, "key").where("cls <> low").groupBy("low", "cls").agg(F.count("*").alias("n"))
    nearest = star.groupBy("cls").agg(F.max_by("low", F.struct("n", "low")).alias("low"))
    pairs = nearest.select(F.least("low", "cls").alias("a"), F.greatest("low", "cls").alias("b")).distinct()
    pairs = scratch.save(_plausible(pairs, classes, percent), "pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    cut = scratch.save(_fragments(docs, reps, used, words, parts), "cut")
    links = scratch.save(_verified(cut, classes, pairs, percent), "links")
    comp = scratch.save(connected_components(links, scratch, "cc_"), "comp")
    # What is still apart, all with all.
    named = members.select("key", "cls").join(comp.select(F.col("node").alias("cls"), "comp"), "cls", "left")
    known = scratch.save(named.withColumn("comp", F.coalesce("comp", "cls")), "known")
    apart = scratch.save(_apart(known, classes, percent), "apart")
    if not apart.isEmpty():
        rest = scratch.save(_fragments(docs, reps, apart.select("cls").distinct(), words, parts), "rest")
        whole = apart.join(rest, "cls").join(classes.select("cls", "n"), "cls")
        dealt = whole.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        more = scratch.save(_by_group(dealt, lambda table, cuts: _forest(table, cuts, percent), "a long, b long").distinct(), "more")
        links = links.unionAll(scratch.save(_verified(rest, classes, more, percent), "forest"))
        comp = scratch.save(connected_components(links, scratch, "cd_"), "all")
    smallest = sets.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("own"))
    named = smallest.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    first = named.groupBy("comp").agg(F.min("own").alias("component_id"))
    of_class = named.join(first, "comp").select("cls", "comp", "component_id")
    out = sets.join(of_class, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "print", F.when(F.col("n") > 0, F.col("comp")).alias("comp"))
    result = scratch.save(out, "result")
    scratch.drop("members", "known", "sets", "classes", "pairs", "cut", "links", "comp", "apart", "rest", "more", "forest", "all")
    return result
