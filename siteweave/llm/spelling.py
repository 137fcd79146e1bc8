"""Spelling variants: words one edit apart, found in a trie of letter-group counts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import as_bytes, map_batches, slices

#: Letter groups whose counts are the levels of the trie, in this order; all other characters are the last group.
GROUPS = ("en", "ti", "ah", "ro", "us", "cl", "dg")

#: Words below one node of the trie's top, which a task holds as a trie of its own; beyond ``MOST_PARTS`` such nodes they grow.
PART_WORDS, MOST_PARTS = 1 << 14, 1 << 16

#: Words that a node lists instead of growing further levels.
LISTED = 4

#: Distinct words that a counting task holds before it hands on its counts.
HELD_WORDS = 1 << 18

#: Pairs of words that a searching task holds before it hands them on.
HELD_PAIRS = 1 << 16

#: Columns of a word on its way to a node, and of a pair.
ROUTED = {"node": "long", "half": "string", "visitor": "boolean", "level": "int", "s": "int", "d": "int", "word": "string", "n": "long"}
PAIRED = {"word": "string", "n": "long", "other": "string", "other_n": "long"}

#: Latin-1 bytes to what word cutting reads: A-Z lowered, a-z and U+00C0..U+00FF kept, all else a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def letter_runs(text: str) -> list[bytes]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lowered, in Latin-1: a byte is a code point."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def count_words(documents: DataFrame, *, shortest: int = 5, least: int = 3, misspell: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: words of at least ``shortest`` code points that occur ``least`` times or more in all whole texts.

    ``misspell`` plants misspellings: where it divides the checksum of
    ``<id>:<word>``, all occurrences of the word in documents of that id lose the
    code point at the checksum modulo the word's length. A null id counts as empty
    there. Null texts have no words; repeated rows count each.

    A task hands on the counts of up to ``HELD_WORDS`` distinct words at a time, so
    that a word of many documents is shuffled once a task, not once a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for part in slices(batches, "text"):
            for name, text in zip(as_bytes(part.column("id")), part.column("text").to_pylist(), strict=True):
                runs = Counter(letter_runs(text)) if text else {}
                seed = zlib.crc32(name + b":")
                for word, n in runs.items():
                    if len(word) < shortest:
                        continue
                    if misspell:
                        check = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                        if check % misspell == 0:
                            at = check % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                    counts[word] += n
            if len(counts) > HELD_WORDS:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    slim = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(slim, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _counted(counts: Counter[bytes]) -> pa.RecordBatch:
    words = pa.array([w.decode("latin-1") for w in counts], pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


class Vectors:
    """Counts of a word's characters by letter group, the last group being all others."""

    def __init__(self, groups: Sequence[str]):
        table = bytearray([len(groups)]) * 256
        for k, letters in enumerate(groups):
            for byte in letters.encode("latin-1"):
                table[byte] = k
        self.table, self.marks = bytes(table), [bytes([k]) for k in range(len(groups) + 1)]

    def __call__(self, word: str) -> tuple[int, ...]:
        kinds = word.encode("latin-1", "replace").translate(self.table)
        return tuple([kinds.count(mark) for mark in self.marks])


def one_edit(short: str, long: str) -> bool:
    """Whether two different words, the second as long or one longer, differ by one inserted or replaced code point."""
    at = 0
    for a, b in zip(short, long, strict=False):
        if a != b:
            break
        at += 1
    return short[at:] == long[at + 1 :] if len(long) > len(short) else short[at + 1 :] == long[at + 1 :]


def descend(node: dict, count: int, level: int, surplus: int, deficit: int, push: Callable[[tuple], None]) -> None:
    """Pushes the children of a node that a word with ``count`` in its group may enter, with the budget that is left."""
    child = node.get(count)
    if child is not None:
        push((child, level + 1, surplus, deficit))
    if surplus:
        child = node.get(count + 1)
        if child is not None:
            push((child, level + 1, surplus - 1, deficit))
    if deficit:
        child = node.get(count - 1)
        if child is not None:
            push((child, level + 1, surplus, deficit - 1))


class Leaf:
    """Words of one frequency vector, filed by their first and by their second half.

    One edit leaves one half of the longer word as it is, so that a search meets
    only words with that half instead of all words of the leaf.
    """

    def __init__(self, rows: list[tuple]):
        self.length = len(rows[0][1])
        self.half = self.length // 2
        self.heads: dict[str, list[tuple]] = {}
        self.tails: dict[str, list[tuple]] = {}
        for row in rows:
            self.heads.setdefault(row[1][: self.half], []).append(row)
            self.tails.setdefault(row[1][self.half :], []).append(row)

    def near(self, word: str) -> list[tuple]:
        if not 0 <= self.length - len(word) <= 1:
            return []
        head, tail = halves(word, self.length)
        found = self.heads.get(head, [])
        others = self.tails.get(tail)
        return found + [row for row in others if row[1][: self.half] != head] if others else found


def halves(word: str, length: int) -> tuple[str, str]:
    """First and second half that ``word`` shares with a word of ``length`` (its own or one more), if one of them is left as it is."""
    half = length // 2
    return word[:half], word[half - (length - len(word)) :]


def grow(rows: list[tuple], depth: int):
    """The trie of ``rows`` (vector, word, n) from a level on: dicts by count, lists of few words, leaves."""
    if len(rows) <= LISTED:
        return rows
    if depth == len(rows[0][0]):
        return Leaf(rows)
    children: dict[int, list[tuple]] = {}
    for row in rows:
        children.setdefault(row[0][depth], []).append(row)
    return {count: grow(part, depth + 1) for count, part in children.items()}


def search(trie, depth: int, vector: Sequence[int], word: str, surplus: int = 1, deficit: int = 1) -> list[tuple]:
    """Words one edit from ``word`` that are one longer, or as long and later in code-point order: depth first, verified at the leaves."""
    found, size, stack = [], len(word), [(trie, depth, surplus, deficit)]
    pop, push = stack.pop, stack.append
    while stack:
        node, level, s, d = pop()
        if type(node) is dict:
            descend(node, vector[level], level, s, d, push)
            continue
        for row in node if type(node) is list else node.near(word):
            other = row[1]
            longer = len(other) - size
            if (longer == 1 or longer == 0 and other > word) and one_edit(word, other):
                found.append(row)
    return found


def top_nodes(words: DataFrame, vectors: Vectors, part_words: int) -> tuple[dict, set[int]]:
    """The trie's top, cut where a node has at most ``part_words`` words: nested dicts by count with node numbers at the cut.

    Level by level, only nodes with more words are opened: one aggregate over the
    counts of the level below each. The second result has the numbers of full
    vectors that still have more words.
    """
    depth, prefixes, top, number, large = len(vectors.marks), {(): None}, {}, 0, set()
    for level in range(depth):
        wanted = [list(p) for p in prefixes]
        keys = F.slice("vector", 1, level)
        listed = words if level == 0 else words.join(F.broadcast(words.sparkSession.createDataFrame([(w,) for w in wanted], "prefix array<int>")), keys == F.col("prefix"), "left_semi")
        grown = listed.groupBy(F.slice("vector", 1, level + 1).alias("prefix")).count().collect()
        prefixes = {}
        for prefix, n in sorted((tuple(r["prefix"]), r["count"]) for r in grown):
            node = top
            for count in prefix[:-1]:
                node = node.setdefault(count, {})
            if n > part_words and level + 1 < depth:
                prefixes[prefix] = n
            else:
                node[prefix[-1]] = number
                if n > part_words:
                    large.add(number)
                number += 1
        if not prefixes:
            break
    return top, large


def near_words(words: DataFrame, *, groups: Sequence[str] = GROUPS, part_words: int = PART_WORDS) -> DataFrame:
    """``word, n, other, other_n`` for every two words of ``words`` (word, n; distinct) one edit apart, in both directions.

    Words are arranged by the counts of their letter groups, one level of a trie a
    group. One inserted code point is a surplus of one in one group; a replaced one
    a surplus and a deficit of one, or none. A depth-first search spends that
    budget; words at the leaves are verified.

    The trie is spread by its nodes of at most ``part_words`` words (more, if there
    would be more than ``MOST_PARTS``). The driver sees the counts of the larger
    nodes' children alone. A word goes to its own node, and to every other that the
    search reaches, with the budget left; a task grows one node's trie at a time and
    lets the visitors stream past. A full vector with more words is dealt out by the
    two halves of its words. No two words of a node are compared but by the search.
    """
    vectors, spark = Vectors(groups), words.sparkSession

    def with_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([vectors(w) for w in b.column("word").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), found], names=["word", "n", "vector"])

    held = cut(map_batches(words.select("word", "n"), with_vector, "word string, n long, vector array<int>"))
    part_words = max(part_words, held.count() // MOST_PARTS)
    top, large = top_nodes(held, vectors, part_words)
    shared = spark.sparkContext.broadcast((top, large))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, split = shared.value
        for batch in batches:
            out: list[tuple] = []
            for word, n, vector in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "vector")), strict=True):
                stack = [(tree, 0, 1, 1)]
                while stack:
                    node, level, s, d = stack.pop()
                    if type(node) is dict:
                        descend(node, vector[level], level, s, d, stack.append)
                        continue
                    visitor = not s == d == 1
                    if node not in split:
                        out.append((node, "", visitor, level, s, d, word, n))
                    elif d >= s:  # the node's words have d - s more code points
                        head, tail = halves(word, len(word) + d - s)
                        out += [(node, "h" + head, visitor, level, s, d, word, n), (node, "t" + tail, visitor, level, s, d, word, n)]
            yield _records(out, ROUTED)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        key, members, trie, level = None, [], None, 0

        def meet(word: str, n: int, vector: tuple, s: int, d: int) -> None:
            near = search(trie, level, vector, word, s, d) if not key[1] else same_half(members, word, key[1])
            for _, other, other_n in near:
                found.append((word, n, other, other_n))
                found.append((other, other_n, word, n))

        def settle() -> None:
            """Grows the node's trie and looks up its own words, once all of them are there."""
            nonlocal trie
            if members and trie is None:
                trie = grow(members, level)
                for vector, word, n in members:
                    meet(word, n, vector, 1, 1)

        for batch in batches:
            for node, half, visitor, at, s, d, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, half) != key:
                    settle()
                    key, members, trie, level = (node, half), [], None, at
                if not visitor:
                    members.append((vectors(word), word, n))
                    continue
                settle()
                if members:
                    meet(word, n, vectors(word), s, d)
                if len(found) > HELD_PAIRS:
                    yield _records(found, PAIRED)
                    found = []
        settle()
        yield _records(found, PAIRED)

    routed = map_batches(held, route, ", ".join(f"{c} {t}" for c, t in ROUTED.items()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = routed.repartition(parts, "node", "half").sortWithinPartitions("node", "half", "visitor")
    return map_batches(together, pair, ", ".join(f"{c} {t}" for c, t in PAIRED.items()))


def same_half(members: list[tuple], word: str, half: str) -> Iterator[tuple]:
    """One-edit partners of ``word`` among words of one vector and one half; those with the same first half belong to that half."""
    for row in members:
        other = row[1]
        longer = len(other) - len(word)
        if (longer == 1 or longer == 0 and other > word) and one_edit(word, other):
            if half[0] == "h" or other[: len(other) // 2] != word[: len(other) // 2]:
                yield row


def _records(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    values = zip(*rows, strict=True) if rows else ([] for _ in columns)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, t in zip(values, columns.values(), strict=True)], names=list(columns))


def group_variants(words: DataFrame, *, ratio: int = 2, groups: Sequence[str] = GROUPS, part_words: int = PART_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for distinct ``words`` (word, n).

    ``n_near`` counts the words one edit away. The form of a word is the near word
    of largest n (ties: smallest in code-point order) if that is at least ``ratio``
    times its own n; the root is where the chain of forms ends, the word itself
    where it has none. Chains grow in n by ``ratio`` (over 1) a step and are
    followed by doubling: each round joins the roots with themselves.

    Rows with a null word or n take no part. Empty words are near to words of one
    code point. An empty table gives no rows; other columns are not read.
    """
    given = cut(words.select("word", F.col("n").cast("long").alias("n")).dropna())
    near = near_words(given, groups=groups, part_words=part_words)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    fits = -F.col("best.minus") >= ratio * F.col("n")
    formed = given.join(best, "word", "left").select(
        "word",
        F.when(fits, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("best.minus")).alias("form_n"),
    )
    formed = cut(formed)
    roots = chain_ends(formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def chain_ends(links: DataFrame) -> DataFrame:
    """``word, root``: where the chain of each word ends, in rounds that double the steps taken; chains without a cycle."""
    links = cut(links)
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(ahead, "root", "left_semi").isEmpty():
            return links
        links = cut(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def variants_sql(shortest: int = 5, least: int = 3, misspell: int = 97, ratio: int = 2) -> str:
    """DuckDB SQL over ``documents``: near words share a word with one code point left out, at the same place where they are as long."""
    step = "list_reduce(list_prepend(CAST(x AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({lowered}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= {shortest} GROUP BY id, run),
b AS (
  SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS bytes,
    (SELECT list_transform(range(256), lambda x: {step})) AS crc
  FROM d),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(bytes, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c >> 8, crc[1 + xor(c, x) % 256]))) AS h FROM b),
e AS (SELECT CASE WHEN h % {misspell} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {least}),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM w),
o AS (SELECT word, n, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest FROM p),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM o a JOIN o b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
  UNION SELECT o.word, w.word, w.n FROM o JOIN w ON o.rest = w.word
  UNION SELECT w.word, o.word, o.n FROM o JOIN w ON o.rest = w.word),
best AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {ratio} * w.n THEN other END AS form, CASE WHEN other_n >= {ratio} * w.n THEN other_n END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word AND place = 1),
chain AS (
  SELECT word, word AS root, form AS further FROM f
  UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON chain.further = f.word)
SELECT f.word, f.form, chain.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN chain ON f.word = chain.word AND chain.further IS NULL"""
