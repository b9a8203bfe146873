"""Operator 7, n-gram Jaccard join by prefixes under several global token orders.

Two sets of sizes n and m with similarity t or more have o = ceil(t (n + m) / (1 + t)) tokens or
more in common, and so share l tokens among the first n - o + l and m - o + l, in whatever order
all tokens are put. Three orders filter one after the other, before any pair is verified:

1. By hash. All documents' prefixes of n - c + 1 + c div 16 tokens (c = ceil(t n)) are counted by
   token; a set of which fewer than 1 + c div 16 of these are in any other set links with none.
   The texts of what is left, one for each different set, are fetched.
2. By frequency among these sets, rare tokens first, exactly counted. Sets meet at a common token
   of their first n - c + 1; its places bound the overlap, as at the pair's first common token.
3. By another hash. Pairs that met share enough of their prefixes under the first and this order.

Whole sets are intersected only then. No large group is paired with itself: equal sets are one
class; a token's classes first meet its hub, the class that has the least rare tokens before it,
and what is linked becomes one component. After `rounds` rounds of hubs, classes of different
components that still share a token are compared, so that no link between components is lost;
a token's largest component meets the others, never itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .sequences import SALT_A, SALT_B, WindowHash, mix, pieces, text_buffers, word_bounds, word_hashes
from .shared import column, row_keys, small_batches, written

#: Rounds in which a token's classes meet its hub; a prefix of the first order is longer by c div SPARE tokens.
ROUNDS, SPARE = 1, 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash) of all distinct shingles, sorted by document and hash, and each document's count."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(raw, offsets)
    codes = word_hashes(_LOWER[raw], starts, ends)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    hashes = WindowHash(codes)
    grams = hashes.windows(k)
    at = np.flatnonzero(doc[: len(grams)] == doc[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
    owner, grams = doc[at], mix(grams[at])
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):  # the whole sequence is the one shingle; slices hash their length too
        owner, grams = np.concatenate([owner, short]), np.concatenate([grams, hashes.slices(first[short], first[short + 1])])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    owner, grams = owner[fresh], grams[fresh]
    return owner, grams, np.bincount(owner, minlength=n)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames, a third as large where they are shuffled."""
    squeeze = zstandard.ZstdCompressor(1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["k1"], batch["k2"], pa.array([squeeze.compress((t or "").encode()) for t in batch["text"].to_pylist()], pa.binary())], ["k1", "k2", "text"])


def _texts(batches: Iterator[pa.RecordBatch]):
    """Pieces of the batches: (batch, first row, end, bytes, offsets); texts may be zstandard frames."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        column = batch["text"]
        if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            column = pa.array([expand.decompress(t) for t in column.to_pylist()], pa.large_binary())
        raw, offsets = text_buffers(column)
        for a, b in pieces(offsets, 256 << 10):
            yield batch, a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _prefix(owner: np.ndarray, grams: np.ndarray, sizes: np.ndarray, longest: np.ndarray) -> pa.ListArray:
    """The first tokens of each document, as many as longest says."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.arange(len(grams)) - bounds[owner] < longest[owner]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(sizes)))]).astype(np.int32)), _signed(grams[keep]))


def _profiles(k: int, num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's class (two commutative hashes of its set), set size, and prefix under the first order."""
    for batch, a, b, raw, offsets in _texts(batches):
        owner, grams, sizes = shingle_sets(raw, offsets, k)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        names = []
        for salt in (SALT_A, SALT_B):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(salt)))])
            names.append(_signed(mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(np.uint64))))
        least = (num * sizes + den - 1) // den
        first = _prefix(owner, grams, sizes, sizes - least + 1 + least // SPARE)
        yield pa.RecordBatch.from_arrays([*[batch[c].slice(a, b - a) for c in ("row_id", "d", "k1", "k2")], *names, pa.array(sizes), first], ["row_id", "d", "k1", "k2", "ca", "cb", "n", "first"])


def _sets(k: int, num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class's whole set, and its prefixes under the first and the third order."""
    for batch, a, b, raw, offsets in _texts(batches):
        owner, grams, sizes = shingle_sets(raw, offsets, k)
        least = (num * sizes + den - 1) // den
        other = grams[np.lexsort((mix(grams ^ np.uint64(SALT_B)), owner))]
        lists = [_prefix(owner, grams, sizes, sizes), _prefix(owner, grams, sizes, sizes - least + 1 + least // SPARE), _prefix(owner, other, sizes, sizes - least + 1)]
        yield pa.RecordBatch.from_arrays([*[batch[c].slice(a, b - a) for c in ("ca", "cb")], pa.array(sizes), *lists], ["ca", "cb", "n", "tokens", "first", "third"])


def _linked(docs: DataFrame, k: int, num: int, den: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(d, k1, k2, ca, cb, n) of each row, and for each class with tokens the first row of its component (x: unnamed, d, k1, k2)."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select(F.col("doc_id").alias("d"), *row_keys(docs), F.coalesce("text", F.lit("")).alias("text"))
    numbered = base.withColumn("row_id", F.monotonically_increasing_id())
    profiles = written(numbered.mapInArrow(partial(_profiles, k, num, den), f"row_id long, d {kind}, k1 long, k2 long, ca long, cb long, n long, first array<long>"), "profiles")
    classes = profiles.where("n > 0").groupBy("ca", "cb").agg(F.min(F.struct(F.col("d").isNull().alias("unnamed"), "d", "k1", "k2")).alias("x"))

    # first order: tokens that different sets have in their prefixes, and the sets that have enough of them
    posted = profiles.select("row_id", F.explode("first").alias("token"))
    meeting = profiles.select("ca", F.explode("first").alias("token")).groupBy("token").agg(F.min("ca").alias("one"), F.max("ca").alias("other")).where("one <> other").select("token")
    meeting = written(meeting, "tokens")
    enough = posted.join(meeting.hint("shuffle_merge"), "token").groupBy("row_id").agg(F.count("*").alias("met"))
    least = f"(({num} * n + {den - 1}) div {den})"
    left = profiles.select("row_id", "ca", "cb", "n").join(enough.hint("shuffle_merge"), "row_id").where(f"met > {least} div {SPARE}").select("ca", "cb").distinct()
    wanted = written(left.join(classes.hint("shuffle_merge"), ["ca", "cb"]).select("ca", "cb", "x.k1", "x.k2"), "wanted")
    squeezed = base.select("k1", "k2", "text").mapInArrow(_squeezed, "k1 long, k2 long, text binary")
    texts = squeezed.join(wanted.hint("shuffle_merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("ca", "cb", "text")
    made = texts.mapInArrow(partial(_sets, k, num, den), "ca long, cb long, n long, tokens array<long>, first array<long>, third array<long>")
    sets = written(made.withColumn("class", F.monotonically_increasing_id()), "sets")

    # second order: rare tokens first; tokens of one set only come before all others
    tokens = sets.select("class", "n", F.explode("tokens").alias("token"))
    counted = written(tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1"), "counted")
    own = Window.partitionBy("class")
    ranked = tokens.join(counted.hint("shuffle_merge"), "token").select(
        "class", "n", "token", (F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("sets", "token")) - 1).alias("place")
    )
    postings = written(ranked.where(f"place <= n - {least}").select("token", "class", "n", "place"), "postings")

    # the bound on the overlap from a shared token's places holds at the pair's first shared token
    possible = f"least(n, m) * {den} >= greatest(n, m) * {num} AND {den + num} * least(n - place, m - spot) >= {num} * (n + m)"
    overlap = f"(({num} * (n + m) + {den + num - 1}) div {den + num})"
    most, fewest = (f"(({num} * {f}(n, m) + {den - 1}) div {den})" for f in ("greatest", "least"))
    in_first = f"least({overlap} - {most} + 1 + {most} div {SPARE}, {overlap} - {fewest} + 1 + {fewest} div {SPARE})"
    in_third = f"({overlap} - {most} + 1)"

    def sides(pairs: DataFrame, *columns: str) -> DataFrame:
        """pairs (a, b) with columns of both classes, named column_a and column_b."""
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("class").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        ranked = sides(pairs, "n", "first", "third").withColumnsRenamed({"n_a": "n", "n_b": "m"})
        left = ranked.where(f"size(array_intersect(first_a, first_b)) >= {in_first} AND size(array_intersect(third_a, third_b)) >= {in_third}").select("a", "b", "n", "m")
        common = sides(left, "tokens").select("a", "b", "n", "m", F.expr("size(array_intersect(tokens_a, tokens_b))").alias("common"))
        return common.where(f"common > 0 AND {den} * common >= {num} * (n + m - common)").select("a", "b")

    links, roots = None, None
    for turn in range(rounds + 1):
        if roots is None:
            placed = postings.withColumn("root", F.col("class"))
        else:
            placed = postings.join(roots.hint("shuffle_merge"), F.col("class") == F.col("node"), "left").select("token", "class", "n", "place", F.coalesce("root", "class").alias("root"))
        if turn < rounds:
            order = F.struct("place", -F.col("n"), "class", "n", "root") if not turn else F.struct(F.xxhash64("class", F.lit(turn)), "place", "class", "n", "root")
            hubs = placed.groupBy("token").agg(F.min(order).alias("x"), F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other")
            hubs = written(hubs.select("token", F.col("x.class").alias("partner"), F.col("x.n").alias("m"), F.col("x.place").alias("spot"), F.col("x.root").alias("heart")), "hubs")
            met = placed.join(hubs.hint("shuffle_merge"), "token").where(f"root <> heart AND {possible}")
        else:
            # a token's largest component is not compared with itself, and its members only with the others
            held = placed.groupBy("token", "root").agg(F.count("*").alias("rows")).groupBy("token").agg(F.max(F.struct("rows", "root")).alias("x"), F.count("*").alias("roots"))
            held = written(held.where("roots > 1").select("token", F.col("x.root").alias("main")), "open")
            open_ = written(placed.join(held.hint("shuffle_merge"), "token"), "placed")
            other = open_.select("token", F.col("class").alias("partner"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("root").alias("heart"))
            met = open_.where("root <> main").join(other.hint("shuffle_merge"), "token").where(f"root <> heart AND (heart = main OR root < heart) AND {possible}")
        # a table of its own, so that its size decides how the sets are joined
        pairs = written(met.select(F.least("class", "partner").alias("a"), F.greatest("class", "partner").alias("b")).distinct(), "pairs")
        found = written(verified(pairs), "links")
        if found.take(1):
            links = found if links is None else links.unionByName(found)
            roots = written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")
    if roots is None:
        return profiles, written(classes, "labels")
    members = written(sets.select("ca", "cb", "class").join(roots.hint("shuffle_merge"), F.col("class") == F.col("node")).select("ca", "cb", "root"), "members")
    chief = written(members.join(classes.hint("shuffle_merge"), ["ca", "cb"]).groupBy("root").agg(F.min("x").alias("chief")), "chiefs")
    linked = members.join(chief.hint("shuffle_merge"), "root").select("ca", "cb", "chief")
    # a table of its own, so that the join with the rows can split a class that many rows share
    return profiles, written(classes.join(linked.hint("shuffle_merge"), ["ca", "cb"], "left").select("ca", "cb", F.coalesce("chief", "x").alias("x")), "labels")


def jaccard_join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, row_id, n_shingles, component_id for each row of docs (doc_id, text): A-Z lower-cased, `k`-word shingles.

    Rows link when den * intersection >= num * union. component_id is the least doc_id that links
    reach; ties between equal ids do not matter. Null and empty texts have no shingles and link
    with nothing; equal texts of other rows link. A null doc_id takes part, and is the component's
    id only if no other is there; ids of any type that has an order will do. Long texts are held
    one at a time. Sets are told apart by 128 bits of hash, shingles by 64. row_id is a number for
    each input row, 0 upwards within a task, and only fixed for one call. An empty table gives an
    empty table; other columns are not read.
    """
    rows, labels = _linked(docs, k, num, den, rounds)
    found = labels.select("ca", "cb", F.col("x.d").alias("least"))
    out = rows.select("row_id", "d", "ca", "cb", "n").join(found.hint("shuffle_merge"), ["ca", "cb"], "left")
    return out.select(F.col("d").alias("doc_id"), "row_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("d")).alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, rounds: int = ROUNDS) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, a null one last. Texts without words all stay, once for each doc_id.

    Of repeated rows, equal in doc_id and text, one stays, whatever other columns they have.
    """
    rows, labels = _linked(docs, k, num, den, rounds)
    chosen = labels.select("x.k1", "x.k2").distinct().unionByName(rows.where("n = 0").select("k1", "k2").distinct())
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("quillon_0", "quillon_1"):
        while name in taken:
            name += "_"
        names.append(name)
    named = docs.select(*[key.alias(name) for key, name in zip(row_keys(docs), names)], *[column(c) for c in docs.columns])
    kept = named.join(chosen.toDF(*names).hint("shuffle_merge"), names).dropDuplicates(names)
    return kept.select(*[column(c) for c in docs.columns])
