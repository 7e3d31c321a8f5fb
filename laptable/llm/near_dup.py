"""Near duplicates by MinHash signatures and a multi-index Hamming join, confirmed on full shingle sets.

1. Every text becomes the set of its word shingles, kept as sorted 64-bit hashes inside a task only; out of it come the set's
   size, a 128-bit digest and a signature of 84 symbols, each the lowest 16 bits of one minimum.
2. Documents with one digest are one class with a number of its own and its smallest id, so copies cost nothing below and
   two texts under one id stay two classes.
3. The signature is cut into 14 chunks of 6 symbols. Two signatures that differ in at most 27 symbols have, by the pigeonhole
   principle, a chunk with at most one differing symbol. Chunks are looked up with one symbol left out at a time (84 keys a
   class), so that every such pair shares a key. Beyond 27 symbols pairs are still found unless all 14 chunks have two
   errors: at similarity 0.8 that is a chance of 3e-7.
4. Classes that share a key are first compared with the smallest class of the key. Links that hold give components. Where a
   key still holds several, rounds follow with other centres, one pair a class and round, until a round finds no link (``ROUNDS``
   at most; the blocks do what is left), and the components are taken anew. Members of keys that then still hold several components are compared in blocks of
   bounded size. There, sets of up to 256 shingles are compared by the lowest 16 bits of their hashes, which can only
   overstate what two sets share; longer ones by a sketch of 4096 one-bit minima. Only pairs of different components come out that
   these bits leave possible, or whose sketches differ in at most 515 bits (beyond five deviations at similarity 0.8), each
   under the first key it shares. No group is gathered and no pairs within a component
   are made.
5. Candidate pairs are confirmed by the intersection of the whole sets; components follow from the links. Texts are read again
   once, for the sets of all classes that share a key; sketches and confirmations use these stored sets.

Defined cases: null or empty texts have an empty set and are linked with nothing; fewer words than a shingle make one shingle
of all; rows of one id and equal text are copies of each other (one stays), with different texts they are documents each; rows without an id are linked with nothing and
kept; an empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laptable.llm.common import bounded_broadcast, cut_lineage, stored
from laptable.llm.components import components
from laptable.llm.texthash import BASE, U, mix, numbers, shingle_sets
from laptable.llm.tokens import slices

CHUNKS, PER_CHUNK, SYMBOL = 14, 6, np.dtype("<u2")
SYMBOLS = CHUNKS * PER_CHUNK
#: Signatures that differ in more symbols are not compared further (beyond six deviations at similarity 0.8).
MOST_DIFFERING = 40
#: Bits of a sketch, and in how many two sketches may differ (beyond five deviations at similarity 0.8).
SKETCH, MOST_BITS = 4096, 515
#: Sets of up to so many shingles are compared by 16 bits of each hash in place of a sketch of the same length.
SHORT = SKETCH // 16
#: Members of one key are compared in blocks of about so many; rounds of single centres before that.
BLOCK, ROUNDS = 1024, 4
SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, signature binary"
FACTORS, SHIFTS = numbers(SKETCH, 2) | U(1), numbers(SKETCH, 3)


def _minima(hashes: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, np.iinfo(U).max, U)
    rows = max(1, (1 << 19) // n)
    for i in range(0, len(hashes), rows):
        np.minimum(least, (hashes[i : i + rows, None] * FACTORS[:n] + SHIFTS[:n]).min(axis=0), out=least)
    return least


def signature(hashes: np.ndarray) -> bytes:
    return (_minima(hashes, SYMBOLS) & U(0xFFFF)).astype(SYMBOL).tobytes()


def sketch(hashes: np.ndarray) -> bytes:
    """One bit of each minimum, taken from its middle so that it does not depend on how small the minimum is."""
    return np.packbits((mix(_minima(hashes, SKETCH)) >> U(32) & U(1)).astype(bool)).tobytes()


def _short(items: bytes) -> np.ndarray:
    """The different lowest 16 bits of a stored set."""
    return np.unique(np.frombuffer(items, U).astype(SYMBOL))


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two sums of mixed hashes per set."""
    return [pa.array([int(mix(x + U(k)).sum(dtype=U).view(np.int64)) for x in sets], pa.int64()) for k in (11, 12)]


def _signed(docs: DataFrame, words: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column("text"), words))
                sizes = pa.array([len(x) for x in sets], pa.int64())
                signs = pa.array([signature(x) if len(x) else None for x in sets], pa.binary())
                names = ["doc_id", "n_shingles", "d1", "d2", "signature"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, *_digests(sets), signs], names=names)

    return cut_lineage(docs.mapInArrow(sign, SIGNED))


def keys_of(signs: np.ndarray) -> np.ndarray:
    """The keys of each signature: a hash of every chunk without one of its symbols."""
    signs = signs.reshape(-1, CHUNKS, PER_CHUNK).astype(U)
    keys = np.empty(signs.shape, U)
    for out in range(PER_CHUNK):
        rows = np.broadcast_to(np.arange(CHUNKS, dtype=U) * U(PER_CHUNK) + U(out), signs.shape[:2])
        for k in (k for k in range(PER_CHUNK) if k != out):
            rows = mix(rows * U(BASE) + signs[:, :, k])
        keys[:, :, out] = rows
    return keys.reshape(len(signs), SYMBOLS)


def _keys(classes: DataFrame) -> DataFrame:
    """A key for every chunk and left-out symbol."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                keys = keys_of(np.frombuffer(b"".join(part.column("signature").to_pylist()), SYMBOL).reshape(-1, SYMBOLS))
                reps = np.repeat(np.asarray(part.column("rep")), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(reps)], names=["key", "rep"])

    return classes.select("rep", "signature").mapInArrow(look, "key long, rep long")


def _first_key(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For one signature and several: the number (chunk and left-out symbol) of the first key that the two share."""
    differ = (others != one).reshape(-1, CHUNKS, PER_CHUNK)
    errors = differ.sum(axis=2)
    chunk = (errors <= 1).argmax(axis=1)
    rows = np.arange(len(others))
    return chunk * PER_CHUNK + differ[rows, chunk].argmax(axis=1)


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and signatures leave the similarity possible."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [np.frombuffer(b"".join(batch.column(c).to_pylist()), SYMBOL).reshape(-1, SYMBOLS) for c in ("sa", "sb")]
            close = (left != right).sum(axis=1) <= MOST_DIFFERING
            yield batch.select(["a", "b"]).filter(pa.array(close))

    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return sized.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def _stored_sets(members: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``rep, items`` (stored): the sorted hashes of the sets of some classes, found by digest in the texts of their smallest ids."""
    needed = cut_lineage(classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "d1", "d2"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column("text"), words))
                yield pa.RecordBatch.from_arrays([*_digests(sets), pa.array([x.tobytes() for x in sets], pa.binary())], names=["d1", "d2", "items"])

    n = needed.count()
    found = docs.join(bounded_broadcast(needed.select("doc_id").distinct(), n), "doc_id", "left_semi").select("text")
    found = found.mapInArrow(to_sets, "d1 long, d2 long, items binary").join(bounded_broadcast(needed.drop("doc_id"), n), ["d1", "d2"])
    sets = cut_lineage(found.select("rep", "items"))
    # More rows than classes only where an id and its text repeat.
    return sets if sets.count() == n else cut_lineage(sets.dropDuplicates(["rep"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, mostly_links: bool = True) -> DataFrame:
    """Stored links (u, v): pairs whose whole sets are similar enough.

    Where most pairs are expected to fail, the lowest 16 bits of the hashes go first: what two sets share is at most
    what these share and what fell together in the set that lost fewer, so no link is lost, and whole sets travel
    only for the pairs that are left.
    """

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [_short(x).tobytes() for x in batch.column("items").to_pylist()]
            sizes = [len(x) // 8 for x in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(short, pa.binary()), pa.array(sizes, pa.int64())], names=["rep", "short", "n"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*[batch.column(c).to_pylist() for c in ("xa", "xb", "na", "nb")], strict=True):
                left, right = np.frombuffer(x, SYMBOL), np.frombuffer(y, SYMBOL)
                common = len(np.intersect1d(left, right, assume_unique=True)) + min(n - len(left), m - len(right))
                keep.append(100 * common >= percent * (n + m - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                left, right = np.frombuffer(x, U), np.frombuffer(y, U)
                common = len(np.intersect1d(left, right, assume_unique=True))
                links.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_())).rename_columns(["u", "v"])

    def joined(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        side = lambda x: rows.toDF(x, *[f"{k}{x}" for k in ("x", "n")[: len(rows.columns) - 1]])
        return pairs.join(side("a"), "a").join(side("b"), "b")

    pairs = stored(pairs)
    if not mostly_links:
        used = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        short = sets.join(used, "rep", "left_semi").mapInArrow(shortened, "rep long, short binary, n long")
        pairs = stored(joined(pairs, short).mapInArrow(possible, "a long, b long"))
    return stored(joined(pairs, sets).select("a", "b", "xa", "xb").mapInArrow(confirm, "u long, v long"))


def _sketches(reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored sketches and short sets of some classes; both where partners of either kind are possible."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items").to_pylist()
            bits = [sketch(np.frombuffer(x, U)) if 100 * (len(x) // 8) > percent * SHORT else None for x in items]
            short = [_short(x).tobytes() if len(x) // 8 <= SHORT else None for x in items]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(bits, pa.binary()), pa.array(short, pa.binary())], names=["rep", "sketch", "short"])

    return cut_lineage(sets.join(reps, "rep", "left_semi").mapInArrow(draw, "rep long, sketch binary, short binary"))


class _Sets:
    """The short sets and sketches of a group's members, for comparisons of one with many."""

    def __init__(self, sizes: np.ndarray, sketches: list, shorts: list, percent: int):
        self.sizes, self.percent = sizes, percent
        self.bits = np.frombuffer(b"".join(x or bytes(SKETCH // 8) for x in sketches), U).reshape(-1, SKETCH // 64)
        self.lengths = np.array([len(x or b"") // 2 for x in shorts])
        # Behind its end a row names a place of the table that is never marked.
        self.items = np.full((len(shorts), SHORT), 1 << 16, np.uint32)
        for row, x in zip(self.items, shorts, strict=True):
            row[: len(x or b"") // 2] = np.frombuffer(x or b"", SYMBOL)
        self.table = np.zeros((1 << 16) + 1, bool)

    def possible(self, i: int, at: np.ndarray) -> np.ndarray:
        """Those of ``at`` that may be similar enough to ``i``."""
        by_set = (self.lengths[at] > 0) & (self.lengths[i] > 0)
        long, short = at[~by_set], at[by_set]
        long = long[np.bitwise_count(self.bits[long] ^ self.bits[i]).sum(axis=1, dtype=np.int64) <= MOST_BITS]
        own = self.items[i, : self.lengths[i]]
        self.table[own] = True
        lost = np.minimum(self.sizes[i] - self.lengths[i], self.sizes[short] - self.lengths[short])
        common = self.table[self.items[short]].sum(axis=1) + lost
        self.table[own] = False
        short = short[100 * common >= self.percent * (self.sizes[i] + self.sizes[short] - common)]
        return np.concatenate([long, short])


def _across(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within keys that hold several, compared in blocks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for key, group in zip(batch.column("key").to_pylist(), batch.column("group"), strict=True):
                rows = group.values.flatten()
                rep, comp, size, block = (np.asarray(rows[k]) for k in (0, 1, 2, 3))
                signs = np.frombuffer(b"".join(rows[4].to_pylist()), SYMBOL).reshape(-1, SYMBOLS)
                known = _Sets(size, rows[5].to_pylist(), rows[6].to_pylist(), percent)
                own = keys_of(signs[:1])[0]
                number = int(np.flatnonzero(own == np.array(key).astype(np.int64).view(U))[0])
                blocks = np.unique(block)
                right = block == blocks[-1]
                for i in np.flatnonzero(block == blocks[0]):
                    with_ = right & (comp != comp[i]) & ((rep > rep[i]) | (len(blocks) > 1))
                    with_ &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
                    # Pairs equal in a whole chunk share all its keys, the first of which counts.
                    with_ &= (signs[:, number] != signs[i, number]) | (number % PER_CHUNK == 0)
                    at = np.flatnonzero(with_)
                    at = at[_first_key(signs[i], signs[at]) == number]
                    at = known.possible(i, at)
                    one.append(np.minimum(rep[at], rep[i]))
                    two.append(np.maximum(rep[at], rep[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two))], names=["a", "b"])

    drawn = _sketches(members.select("rep").distinct(), sets, percent)
    # Members of a key's largest component meet the others' blocks only, which have the lower numbers.
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("k"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("all"))
    members = members.join(sizes.select("key", F.col("main.comp").alias("main"), F.col("main.k").alias("k"), "all"), "key")
    is_main = F.col("comp") == F.col("main")
    others, mains = (F.ceil(n / BLOCK).cast("int") for n in (F.col("all") - F.col("k"), F.col("k")))
    of = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    own = F.when(is_main, others + of(mains)).otherwise(of(others))
    other = F.explode(F.sequence(F.lit(0), F.when(is_main, others).otherwise(others + mains) - 1))
    known = classes.select("rep", "n_shingles", "signature").join(drawn, "rep")
    dealt = stored(members.select("key", "rep", "comp", own.alias("own"), other.alias("other"))).join(known, "rep")
    item = F.struct("rep", "comp", "n_shingles", "own", "signature", "sketch", "short")
    groups = dealt.groupBy("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).agg(F.collect_list(item).alias("group"))
    return groups.select("key", "group").where("size(group) > 1").mapInArrow(compare, "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, rep) of keys that hold several components, with theirs."""
    named = members.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return stored(named.join(mixed, "key"))


def _rounds(members: DataFrame, classes: DataFrame, sets: DataFrame, links: DataFrame, tested: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Links, components, members of keys that still hold several, and tested pairs after rounds of one pair per class, each with a centre of another component of its keys."""
    members = _labelled(members, components(links))
    more = None
    for number in range(ROUNDS):
        chance = lambda c: F.struct(F.xxhash64(F.lit(number), c).alias("h"), F.col(c).alias("center"))  # noqa: E731, B023
        centers = members.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(number), "rep"), "rep", "comp")).alias("m"))
        centers = centers.select("key", F.col("m.rep").alias("center"), F.col("m.comp").alias("other"))
        chosen = members.join(centers, "key").where("comp <> other").groupBy("rep").agg(F.min(chance("center")).alias("m"))
        pairs = chosen.select(F.least("rep", "m.center").alias("a"), F.greatest("rep", "m.center").alias("b")).distinct()
        pairs = stored(_near(pairs.join(tested, ["a", "b"], "left_anti"), classes, percent))
        found = _confirmed(pairs, sets, percent)
        tested = tested.unionByName(pairs)
        if found.isEmpty():
            break
        more = found if more is None else more.unionByName(found)
    if more is not None:
        links = links.unionByName(more)
    labels = components(links)
    return links, labels, _labelled(members.select("key", "rep"), labels), tested


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, d1, d2`` of every row; the last two are the digest of its set."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = _signed(docs, words)
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    least = F.min(F.struct("doc_id", "n_shingles", "signature"))
    classes = known.groupBy("d1", "d2").agg(least.alias("m")).select("d1", "d2", "m.doc_id", "m.n_shingles", "m.signature")
    classes = cut_lineage(classes).withColumn("rep", F.monotonically_increasing_id())
    known_docs = docs.where("doc_id IS NOT NULL")

    keys = _keys(classes)
    shared = keys.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("n")).where("n > 1")
    #: The first class of a key that only two share is no more than the other one's partner.
    members = stored(keys.join(shared, "key").where("rep <> center OR n > 2"))
    star = members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    star = stored(_near(star, classes, percent))
    sets = _stored_sets(members.select("rep").union(star.select("a")), classes, known_docs, words)
    links = _confirmed(star, sets, percent)
    links, labels, mixed, tested = _rounds(members.where("n > 2").select("key", "rep"), classes, sets, links, star, percent)
    more = _across(mixed, classes, sets, percent)
    more = _confirmed(more.join(tested, ["a", "b"], "left_anti"), sets, percent, mostly_links=False)
    if not more.isEmpty():
        labels = components(links.union(more))

    comp = F.coalesce(F.col("component"), F.col("rep"))
    linked = cut_lineage(classes.select("d1", "d2", "rep", "doc_id").join(labels, F.col("rep") == F.col("node"), "left").select("d1", "d2", "doc_id", comp.alias("comp")))
    least = linked.groupBy("comp").agg(F.min("doc_id").alias("component"), F.count("*").alias("n")).where("n > 1").select("comp", "component")
    found = linked.join(least, "comp", "left").select("d1", "d2", F.coalesce("component", "doc_id").alias("component"))
    joined = signed.join(found, ["d1", "d2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), "d1", "d2")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with the smallest id of each component, with the columns they came with; rows without an id stay."""
    found = near_duplicates(docs, words, percent, text, doc_id)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("_row"), F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_copy"))
    rows = rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    if not twice:
        nameless = rows.where("_id IS NULL")
        rows = rows.where("_id IS NOT NULL").dropDuplicates(["_id", "_copy"]).unionByName(nameless)
    return rows.select("_row.*")
