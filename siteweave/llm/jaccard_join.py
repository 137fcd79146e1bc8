"""Set-similarity self-join on word n-grams: rare-first prefixes, filters, one verification a pair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import spread_join
from ..session import cut
from .common import as_bytes, free_name, map_batches, parallel, slices
from .shingles import mix, shingle_sets

#: Buckets of the frequency table that orders n-grams, and of the table of wanted texts. Their size bounds what is broadcast.
FREQUENCY_BITS, WANTED_BITS = 18, 21

#: Documents of one n-gram that a task may see; n-grams beyond it are split by a salt.
HOT = 1 << 16

#: Parts of a suffix whose sizes are compared, eight bits each in one long.
PARTS = 8

#: Parts of a whole set, a byte each, for the pairs that are left.
FINE_PARTS = 256

#: Sets of one part of a component, and their bytes; the pairs of two parts are counted at once.
PART_SETS, PART_BYTES = 512, 16 << 20

#: Documents of a component that one task ties to its smallest id.
COMPONENT_ROWS = 1 << 10

#: N-grams whose presence in the sets of two parts is multiplied at once.
COLUMNS = 1 << 12


@dataclass(frozen=True)
class Overlap:
    """The link rule: 100 * intersection >= ``percent`` * union, in whole numbers."""

    percent: int

    def prefix(self, n: int) -> int:
        """N-grams of a set of ``n`` of which a linked set must have one."""
        return n + (-self.percent * n) // 100 + 1

    def needed(self, a: Column, b: Column) -> Column:
        """Smallest intersection of linked sets of these sizes."""
        return F.ceil(F.lit(self.percent) * (a + b) / F.lit(100 + self.percent) - F.lit(1e-9))

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)


def class_id(grams: np.ndarray) -> int:
    """One number for equal sets."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _buckets(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)


def _fine_parts(grams: np.ndarray) -> bytes:
    sizes = np.bincount((grams & np.uint64(FINE_PARTS - 1)).astype(np.int64), minlength=FINE_PARTS)
    return np.minimum(sizes, 255).astype(np.uint8).tobytes()


def keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, text, key``; the key is the same for repeated rows."""
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("key", F.xxhash64("_id", "text"))


def described(texts: DataFrame, size: int) -> DataFrame:
    """Per text ``_id, key, n, cid, parts`` and, from each partition, rows ``bucket, found``: how many of its sets have an n-gram there.

    ``parts`` are the sizes of 256 parts of the set. Sets that a partition has
    seen are not counted again and have no parts.
    """
    kind = texts.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << FREQUENCY_BITS, dtype=np.int64), set()
        id_type = None
        for part in slices(batches):
            id_type = part.schema.field("_id").type
            sets = shingle_sets(as_bytes(part.column("text")), size)
            ids = [class_id(s) if len(s) else None for s in sets]
            fresh = [c is not None and not (c in seen or seen.add(c)) for c in ids]
            if any(fresh):
                new = np.concatenate([s for s, is_new in zip(sets, fresh, strict=True) if is_new])
                counts += np.bincount(_buckets(new), minlength=len(counts))
            parts = [_fine_parts(s) if is_new else None for s, is_new in zip(sets, fresh, strict=True)]
            blank, n = pa.nulls(len(sets), pa.int64()), pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("key"), n, pa.array(ids, pa.int64()), pa.array(parts, pa.binary()), blank, blank], names=names
            )
        at = np.flatnonzero(counts)
        if len(at):
            blank = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(at), id_type), blank, blank, blank, pa.nulls(len(at), pa.binary()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                names=names,
            )

    names = ["_id", "key", "n", "cid", "parts", "bucket", "found"]
    return map_batches(texts, run, f"_id {kind}, key long, n long, cid long, parts binary, bucket long, found long")


def prefix_postings(texts: DataFrame, frequency: Broadcast, size: int, rule: Overlap, hot: int) -> DataFrame:
    """``token, salt, cid, place, tail`` for the rarest n-grams of each set, rarest first.

    ``place`` has the size of the set and, in the lower 31 bits, the n-gram's place
    in the set's order; ``tail`` the sizes of the parts of what follows it. ``salt`` is the part of a hot n-gram, -1 for others.
    A partition names a set once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = frequency.value, set()
        shifts = np.arange(PARTS, dtype=np.uint64) * np.uint64(8)
        for part in slices(batches):
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for grams in shingle_sets(as_bytes(part.column("text")), size):
                cid = class_id(grams) if len(grams) else None
                if cid is None or cid in seen:
                    continue
                seen.add(cid)
                n, m = len(grams), rule.prefix(len(grams))
                common = counts[_buckets(grams)]
                order = np.lexsort((grams, common))
                own = (mix(grams[order]) & np.uint64(PARTS - 1)).astype(np.int64)
                after = np.bincount(own, minlength=PARTS)[None, :] - np.cumsum(np.eye(PARTS, dtype=np.int64)[own[:m]], axis=0)
                tail = (np.minimum(after, 255).astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)
                salts = -(-common[order[:m]] // hot)
                made = (grams[order[:m]], np.where(salts > 1, cid % np.maximum(salts, 1), -1), np.full(m, cid), (n << 31) + np.arange(m), tail)
                for column, values in zip(columns, made, strict=True):
                    column.append(values)
            if columns[0]:
                flat = [np.concatenate(c) for c in columns]
                as_long = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in flat]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([a.cast(k) for a, k in zip(as_long, kinds, strict=True)], names=names)

    names = ["token", "salt", "cid", "place", "tail"]
    return map_batches(texts, run, "token long, salt int, cid long, place long, tail long")


def shared_postings(postings: DataFrame) -> DataFrame:
    """Postings of n-grams that more than one set has: ``token, salt, cid, n, pos, tail``, how many there are, and the leader.

    The leader is the set in which the n-gram comes first.
    A set whose n-grams are all shared (the original of many near copies) has the
    shared n-gram further in front than its copies, whose own rarer n-grams precede it.
    """
    same = W.partitionBy("token", "salt")
    n, pos = F.shiftright("place", 31).cast("int"), F.col("place").bitwiseAND((1 << 31) - 1).cast("int")
    leader = F.min(F.struct(pos.alias("pos"), n.alias("n"), "cid", "tail")).over(same)
    several = F.min("cid").over(same) != F.max("cid").over(same)
    # a set may be alone in its part of a hot n-gram
    found = postings.withColumns({"lead": leader, "several": several, "members": F.count(F.lit(1)).over(same)})
    return found.filter("several or salt >= 0").select("token", "salt", "cid", n.alias("n"), pos.alias("pos"), "tail", "members", "lead")


def may_link(a: Column, b: Column, rule: Overlap, first: bool) -> Column:
    """Length, positional and suffix filter for two postings of one n-gram.

    After the n-gram the two sets share at most the shorter suffix, and at most
    half of both less what the sizes of the suffixes' parts differ by. Before it
    they share nothing if it is their ``first`` common n-gram, else at most as many
    as stand before it in either. A pair that may link passes at its first common
    n-gram, so ``first`` may be taken for granted where all n-grams are looked at.
    """
    part = lambda x, k: F.shiftrightunsigned(x["tail"], 8 * k).bitwiseAND(255)
    rest = lambda x: x["n"] - x["pos"] - 1
    apart = sum((F.abs(part(a, k) - part(b, k)) for k in range(1, PARTS)), F.abs(part(a, 0) - part(b, 0)))
    up_to = F.lit(1) if first else F.least(a["pos"], b["pos"]) + 1
    needed = rule.needed(a["n"], b["n"])
    positional = up_to + F.least(rest(a), rest(b)) >= needed
    suffix = 2 * up_to + rest(a) + rest(b) - apart >= 2 * needed
    return rule.sizes_fit(a["n"], b["n"]) & positional & suffix


def likely(pairs: DataFrame, rows: DataFrame, rule: Overlap) -> DataFrame:
    """Pairs that the suffix filter lets pass on whole sets and 256 parts: a set may share no more than both sizes less all differences, halved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8) for c in ("parts_a", "parts_b"))
            apart = np.abs(x.astype(np.int16) - y).reshape(-1, FINE_PARTS).sum(axis=1)
            both = np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))
            needed = -(-rule.percent * both // (100 + rule.percent))
            yield batch.select(["a", "b"]).filter(pa.array(both - apart >= 2 * needed))

    wanted = rows.filter(F.col("parts").isNotNull()).select("cid", "n", "parts").join(_ends(pairs), "cid", "left_semi").dropDuplicates(["cid"])
    held = lambda end: wanted.select(*(F.col(c).alias(f"{c}_{end}" if c != "cid" else end) for c in ("cid", "n", "parts")))
    return map_batches(pairs.join(held("a"), "a").join(held("b"), "b"), run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, rule: Overlap) -> DataFrame:
    """The pairs ``a, b`` whose sets are linked, with their ``common`` n-grams and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[one].as_buffer(), dtype=np.uint64) for c in ("set_a", "set_b"))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= rule.percent * (len(x) + len(y) - common):
                    rows.append({"a": batch.column("a")[one].as_py(), "b": batch.column("b")[one].as_py(), "common": common, "n_a": len(x), "n_b": len(y)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.int64()) for c in ("a", "b", "common", "n_a", "n_b")]))

    # both joins read one shuffle of the sets
    held = lambda end: sets.select(F.col("cid").alias(end), F.col("grams").alias(f"set_{end}"))
    met = pairs.join(held("a").hint("merge"), "a").join(held("b").hint("merge"), "b")
    return map_batches(met, run, "a long, b long, common long, n_a long, n_b long").dropDuplicates(["a", "b"])


def sets_of(texts: DataFrame, wanted: DataFrame, described_texts: DataFrame, size: int) -> DataFrame:
    """``cid, grams`` of the sets named in ``wanted`` (cid), made anew from one text each.

    A table of ``2**21`` bits goes to every task: texts whose key is not in it are
    passed over. Where it fills up, more sets are made than needed; the join that
    follows keeps the right ones.
    """
    one_text = described_texts.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min("key").alias("key"))
    slots = one_text.select(F.pmod("key", F.lit(1 << WANTED_BITS)).alias("slot")).distinct().toPandas()["slot"].to_numpy()
    flags = np.zeros(1 << WANTED_BITS, dtype=bool)
    flags[slots.astype(np.int64)] = True
    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted_slots, seen = np.unpackbits(sent.value).astype(bool), set()
        for batch in batches:
            keys = np.asarray(batch.column("key")) & ((1 << WANTED_BITS) - 1)
            for part in slices(iter([batch.filter(pa.array(wanted_slots[keys]))])):
                rows = []
                for grams in shingle_sets(as_bytes(part.column("text")), size):
                    cid = class_id(grams)
                    if len(grams) and cid not in seen:
                        seen.add(cid)
                        rows.append((cid, grams.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cid", "grams"]
                )

    return map_batches(texts.select("key", "text"), run, "cid long, grams binary")


def connected(edges: DataFrame) -> DataFrame:
    """``cid, root`` for all ends of ``edges`` (a, b): the smallest id that can be reached.

    Every round ties each node's larger neighbours to its smallest one, then each
    node and its smaller neighbours to the smallest of them, until nothing
    changes. Rounds are written, so that lineage stays short; minima are combined
    before they are shuffled.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("cid"), F.col("v").alias("root")).distinct()
    )


def link_sets(documents: DataFrame, *, size: int = 4, percent: int = 85, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text"):
    """Descriptions of all texts (``_id, key, n, cid``), verified links between sets, and roots of linked sets."""
    spark, rule = documents.sparkSession, Overlap(percent)
    texts = keyed(documents, id_col, text_col)
    first = cut(described(texts, size))
    described_texts = first.filter(F.col("bucket").isNull())
    rows = described_texts.drop("parts", "bucket", "found")
    frequency = np.zeros(1 << FREQUENCY_BITS, dtype=np.int64)
    table = first.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("found").alias("found")).toPandas()
    frequency[table["bucket"].to_numpy(dtype=np.int64)] = table["found"].to_numpy(dtype=np.int64)
    sent = spark.sparkContext.broadcast(frequency)

    postings = cut(shared_postings(prefix_postings(texts, sent, size, rule, hot)))
    order = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    # first round: every set with the leader of each of its n-grams, leaders of the parts of a hot n-gram with its first
    one = F.struct("n", "pos", "tail")
    stars = postings.filter(F.col("cid") != F.col("lead.cid")).filter(may_link(one, F.col("lead"), rule, first=False))
    tops = postings.filter("salt >= 0").groupBy("token").agg(F.min("lead").alias("top"))
    leads = postings.filter("salt >= 0").select("token", "lead").distinct()
    hot_stars = leads.join(tops, "token").filter("lead.cid <> top.cid").filter(may_link(F.col("lead"), F.col("top"), rule, first=False))
    near = stars.select(*order(F.col("cid"), F.col("lead.cid"))).unionByName(hot_stars.select(*order(F.col("lead.cid"), F.col("top.cid"))))
    near = cut(near.distinct())
    hopeful = cut(likely(near, described_texts, rule))
    links = cut(verified(hopeful, sets_of(texts, _ends(hopeful), rows, size), rule))
    roots = connected(links)

    # second round: the pairs of different components that remain, none of which the first has verified;
    # of each n-gram the sets outside its main component (that of its leader) with all of its sets
    root = roots.select("cid", F.col("root").alias("_root"))
    own = postings.filter("members > 2 or salt >= 0").select("token", "cid", "n", "pos", "tail", F.col("lead.cid").alias("lead_cid"))
    own = cut(own.join(root, "cid", "left").withColumn("root", F.coalesce("_root", "cid")).drop("_root").distinct())
    main = own.groupBy("token").agg(F.min(F.when(F.col("cid") == F.col("lead_cid"), F.struct("pos", "n", "cid", "root"))).alias("main"))
    several = own.groupBy("token").agg((F.min("root") != F.max("root")).alias("several")).filter("several").select("token")
    main = main.join(several, "token", "left_semi").select("token", F.col("main.root").alias("main"))
    own = cut(own.join(main, "token"))
    apart, other = own.filter(F.col("root") != F.col("main")).alias("x"), own.alias("y")
    met = (
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.root") != F.col("y.root"))
        & ((F.col("y.root") == F.col("y.main")) | (F.col("x.cid") < F.col("y.cid")))
        & (F.col("x.cid") != F.col("y.lead_cid"))
        & (F.col("y.cid") != F.col("x.lead_cid"))
    )
    sides = [F.struct(*(F.col(f"{s}.{c}").alias(c) for c in ("n", "pos", "tail"))) for s in "xy"]
    rest = apart.join(other, met & may_link(*sides, rule, first=True)).select(*order(F.col("x.cid"), F.col("y.cid"))).distinct()
    rest = cut(rest.join(near, ["a", "b"], "left_anti"))
    rest = cut(likely(rest, described_texts, rule))
    more = cut(verified(rest, sets_of(texts, _ends(rest), rows, size), rule))
    if not more.isEmpty():
        # a tree of each component of the first round stands for its links
        tree = roots.select(F.col("cid").alias("a"), F.col("root").alias("b"))
        roots = connected(tree.unionByName(more.select("a", "b")))
    return rows, links.unionByName(more), roots


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of ``x`` has in common with each of ``y``."""
    flat_x, flat_y = np.concatenate(x), np.concatenate(y)
    of_x, of_y = (np.repeat(np.arange(len(s)), [len(g) for g in s]) for s in (x, y))
    shared = np.intersect1d(flat_x, flat_y)
    total = np.zeros((len(x), len(y)), dtype=np.int64)
    for start in range(0, len(shared), COLUMNS):
        own = shared[start : start + COLUMNS]
        sides = []
        for flat, of, count in ((flat_x, of_x, len(x)), (flat_y, of_y, len(y))):
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            hit = own[at] == flat
            side = np.zeros((count, len(own)), dtype=np.float32)
            side[of[hit], at[hit]] = 1
            sides.append(side)
        total += (sides[0] @ sides[1].T).astype(np.int64)
    return total


def paired_parts(sets: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, i, j, part, cid, grams``: the sets of parts ``i`` and ``j`` of each component, for all i <= j.

    The number of parts follows from the count and the bytes of a component's
    sets, so that no (root, i, j) grows with the component.
    """
    members = rows.filter("n > 0").select("cid", "n").dropDuplicates(["cid"]).join(roots, "cid")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / PART_SETS), F.ceil(8 * F.sum("n") / PART_BYTES)).cast("int")
    large = members.groupBy("root").agg(parts.alias("parts")).filter("parts > 1")
    members = members.join(large, "root", "left").select("cid", "root", F.coalesce("parts", F.lit(1)).alias("parts"))
    dealt = sets.dropDuplicates(["cid"]).join(members, "cid").withColumn("part", F.pmod("cid", F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cid", "grams")
    return parallel(dealt, "root", "i", "j").sortWithinPartitions("root", "i", "j")


def links_within(parts: DataFrame, rule: Overlap, pairs: bool = False) -> DataFrame:
    """All links of the sets in ``paired_parts``: ``cid, n_links``, or the pairs ``a, b`` themselves, each once."""

    def linked(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        sides = [[h for h in held if h[0] == part] for part in dict.fromkeys(key[1:])]
        x, y = sides[0], sides[-1]
        cids, sizes = ([np.array([v(h) for h in s], dtype=np.int64) for s in (x, y)] for v in (lambda h: h[1], lambda h: len(h[2])))
        linked = np.zeros((len(x), len(y)), dtype=bool)
        if x and y:
            common = common_counts([h[2] for h in x], [h[2] for h in y])
            linked = 100 * common >= rule.percent * (sizes[0][:, None] + sizes[1][None, :] - common)
        if len(sides) == 1:
            linked = np.triu(linked, 1)
        if pairs:
            at = np.nonzero(linked)
            a, b = cids[0][at[0]], cids[1][at[1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        found = [linked.sum(axis=1), linked.sum(axis=0)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (cids, found)], names=["cid", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j")), strict=True)
            values = zip(*(batch.column(c).to_pylist() for c in ("part", "cid", "grams")), strict=True)
            for now, (part, cid, grams) in zip(keys, values, strict=True):
                if now != key and held:
                    yield linked(key, held)
                    held = []
                key = now
                held.append((part, cid, np.frombuffer(grams, dtype=np.uint64)))
        if held:
            yield linked(key, held)

    if pairs:
        return map_batches(parts, run, "a long, b long")
    return map_batches(parts, run, "cid long, found long").groupBy("cid").agg(F.sum("found").alias("n_links"))


def every_link(documents: DataFrame, found: tuple[DataFrame, DataFrame, DataFrame], *, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", pairs: bool = False) -> DataFrame:
    """Every link between different sets, given what ``link_sets`` found: ``cid, n_links``, or with ``pairs`` the links ``a, b``.

    No two linked sets are in different components, so the sets of a component
    are compared with one another and with no others. The work grows with the
    square of a component's size, as its links may; counts need a row for each
    set and pair of parts only.
    """
    rows, _, roots = found
    sets = sets_of(keyed(documents, id_col, text_col), roots.select("cid"), rows, size)
    return links_within(paired_parts(sets, rows, roots), Overlap(percent), pairs)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """``id, row_key, n_shingles, class_id, n_links, component_id`` for every document.

    Two documents link when ``100 * intersection >= percent * union`` of their
    sets of distinct ``size``-word shingles (A-Z lowered, words between white
    space). ``component_id`` is the smallest id reachable by links, ``class_id``
    the same for equal sets, and ``n_links`` counts all links of the class to
    other classes.

    How: the n-grams of each set are ordered by how many sets have them (counts of
    all documents, by hash bucket), rarest first. A linked pair shares an n-gram
    of both prefixes, so only those are shuffled. Sets meet the leader of each
    shared n-gram first, which ties large groups of near copies together without
    their pairs; then only pairs across components are candidates. Length,
    positional and suffix filters go before every verification, and each pair is
    verified once on its whole sets. Equal sets are one set from the start.

    Frequency buckets only order n-grams; a bad order costs time, never a link.
    Sets and n-grams are compared by 64-bit hashes.

    Texts without words, null ones included, have no set: 0 shingles, no links,
    their own id as component. Documents without id take part and count for
    nothing in the smallest id. Of rows that repeat an id each goes by its own
    text. Only id and text are read. An empty table gives no rows. ``row_key``
    hashes id and text.
    """
    found = link_sets(documents, id_col=id_col, **kw)
    degree = cut(every_link(documents, found, id_col=id_col, **{k: v for k, v in kw.items() if k != "hot"}))
    tied = _tied(found[0], found[2]).join(degree.withColumnRenamed("cid", "class_id"), "class_id", "left")
    columns = ["_id", "row_key", "n_shingles", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id"]
    return tied.select(*columns).withColumnRenamed("_id", id_col)


def _tied(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``_id, row_key, n_shingles, class_id, component_id`` for every document."""
    full = cut(rows.filter("n > 0").join(roots, "cid", "left").select("_id", "key", "n", "cid", F.coalesce("root", "cid").alias("root")))
    least = full.groupBy("root").agg(F.min("_id").alias("component_id"))
    # a component with very many documents is dealt out over parts
    tied = spread_join(full, least, ["root"], COMPONENT_ROWS).select("_id", F.col("key").alias("row_key"), F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"), "component_id")
    empty = rows.filter("n = 0").select(
        "_id", F.col("key").alias("row_key"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.col("_id").alias("component_id")
    )
    return tied.unionByName(empty)


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Documents with one of each component, the one with the smallest id; all columns kept.

    Documents without words stay, as do those without id that only others without id resemble. A row leaves by
    id and text; of rows with equal id and text one stays.
    """
    rows, _, roots = link_sets(documents, id_col=id_col, text_col=text_col, **kw)
    found = cut(_tied(rows, roots).withColumnRenamed("_id", id_col))
    own, key = F.col(id_col).eqNullSafe(F.col("component_id")), free_name(documents, "_row_key")
    with_key = documents.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col).cast("string")))
    gone = cut(found.filter(~own).select(F.col("row_key").alias(key)).distinct())
    kept = with_key.join(gone, key, "left_anti")
    again = cut(found.filter(own & (F.col("n_shingles") > 0)).groupBy(F.col("row_key").alias(key)).count().filter("count > 1"))
    if not again.isEmpty():
        several = kept.join(again, key, "left_semi").dropDuplicates([key])
        kept = kept.join(again, key, "left_anti").unionByName(several)
    return kept.drop(key)


def near_duplicates_sql(size: int = 4, percent: int = 85) -> str:
    """DuckDB SQL with the same rows, by brute force over shared shingles."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = (
        f"list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{upper}', '{low}'), "
        "'[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda w: w <> '')"
    )
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {size - 1}), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
linked AS (
  SELECT a, b FROM met JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b
  WHERE 100 * common >= {percent} * (p.n + q.n - common)),
edge AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.seen = edge.a),
class AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS class FROM s GROUP BY doc_id),
degree AS (
  SELECT edge.a AS doc_id, count(DISTINCT y.class) AS n_links
  FROM edge JOIN class x ON x.doc_id = edge.a JOIN class y ON y.doc_id = edge.b AND y.class <> x.class GROUP BY edge.a)
SELECT d.doc_id, CAST(coalesce(max(sized.n), 0) AS BIGINT) AS n_shingles, min(reach.seen) AS component_id, coalesce(max(degree.n_links), 0) AS n_links
FROM d LEFT JOIN sized USING (doc_id) LEFT JOIN reach USING (doc_id) LEFT JOIN degree USING (doc_id) GROUP BY d.doc_id"""
