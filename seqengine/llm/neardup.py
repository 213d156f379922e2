"""Near-duplicate documents by MinHash and a multi-index Hamming join of b-bit signatures.

A document's set holds its distinct shingles of `words` consecutive words. Its signature
has 40 MinHash values of 16 bits, in 10 chunks of 4. Two signatures that differ in at most
19 values have a chunk with at most one difference (10 chunks with two each would be 20),
so both have the same key for that chunk with one value left out: 40 keys a document find
every pair within that distance. A pair at similarity 0.8 exceeds it with a probability
below 0.0001. A pair's link is confirmed on the full sets.

Groups are not expanded into pairs. Documents with the same words are one class. A class is
the more central the more classes share its keys. Each key has a hub, its most central
class, and each class a home, the most central of the hubs of its keys. Classes are first
compared with their homes only, and what links is one component. A key whose classes are in
one component by then is settled. In the others all classes are compared with the hub, on
full sets. Two classes near the same hub are compared by what sets them apart from it
(their delta): if x isn't linked to the hub, a link of x and y needs an overlap of more than
half of y's delta, so a prefix of that length of y's delta meets x's delta. A class that is
not near its key's hub meets the others by prefixes of their sets, the rarest shingles
first: a link needs a common one in both. Pairs within a component are left out. No key is
capped, and a pair within the distance is lost by none of this: all of it is decided on full
sets.

Rows and edge cases: null and empty texts have no words, an empty set and no link; a text
of fewer words than a shingle is one shingle; repeated rows are linked by their equal
words; a null doc_id can link others and never names a component unless all ids in it are
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import let_go, ship
from .common import ASCII_LOWER, WordHashes, byte_texts, connected_components, gram_hashes, in_slices, materialize, mix64, numbered, without

CHUNKS, PER_CHUNK = 10, 4
VALUES = CHUNKS * PER_CHUNK
MOST_DIFFERENT = 2 * CHUNKS - 1
LEAST_PERCENT = 80
#: Shingles are counted in so many buckets (2 MB) to find the common ones.
BUCKET_BITS = 18
#: A signature is kept as 10 numbers of 4 values each.
LANES = [f"s{i}" for i in range(CHUNKS)]

_SEEDS = mix64(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    """Words between spaces and the control characters 9 to 13, A-Z lower-cased."""
    return text.translate(ASCII_LOWER).split()


def shingle_set(numbers: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle."""
    return np.unique(gram_hashes(numbers, min(words, len(numbers)))) if len(numbers) else np.empty(0, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """40 MinHash values, the low 16 bits of each."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            low = np.minimum(low, (shingles[i : i + 4096, None] * _SEEDS).min(axis=0))
        return (mix64(low) & np.uint64(0xFFFF)).astype(np.uint16)


def _digest(words: list[bytes]) -> bytes:
    """Of the whole sequence of words."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """uid, doc_id, n_shingles, digest of the words, and the signature, for each row of docs (uid, doc_id, text)."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashed = WordHashes()
        for batch in in_slices(batches):
            sizes, digests, signed = [], [], []
            for text in byte_texts(batch.column("text")):
                own = words_of(text)
                shingles = shingle_set(hashed(own), words)
                sizes.append(len(shingles))
                digests.append(_digest(own))
                signed.append(signature(shingles) if len(shingles) else np.zeros(VALUES, np.uint16))
            lanes = np.array(signed, dtype=np.uint16).reshape(-1, VALUES).view(np.int64)
            columns = [batch.column("uid"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *(pa.array(lanes[:, i].copy()) for i in range(CHUNKS))]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "n_shingles", "same", *LANES])

    return docs.mapInArrow(sign, "uid long, doc_id long, n_shingles long, same binary, " + ", ".join(f"{x} long" for x in LANES))


def chunk_keys(classes: DataFrame) -> DataFrame:
    """(key, id): each chunk of each signature with each one of its values left out, exactly as bits."""
    keys = []
    for chunk, lane in enumerate(LANES):
        for out in range(PER_CHUNK):
            low = (1 << 16 * out) - 1
            high = ((1 << 48) - 1) & ~low
            keys.append(f"(({lane} & {low}L) | (shiftrightunsigned({lane}, 16) & {high}L) | {(chunk * PER_CHUNK + out) << 48}L)")
    return classes.select(F.explode(F.array(*map(F.expr, keys))).alias("key"), "id")


def _same_values(lane: str) -> str:
    """SQL: how many of the four values of a lane the rows a and b share."""
    return " + ".join(f"int((((a.{lane} ^ b.{lane}) >>> {16 * k}) & 65535) = 0)" for k in range(PER_CHUNK))


_AGREEMENT = " + ".join(f"({_same_values(lane)})" for lane in LANES)


class Bounds:
    """What a similarity of percent means for signatures and deltas.

    A hub's halo is what is similar to it by `inner`; whatever is similar enough to link to a
    class that is similar to the hub by inner + 1 - percent, is in the halo as well.
    A home is compared only with what agrees with it in halo_same values; what that leaves
    out is compared in the keys that stay open.
    """

    def __init__(self, percent: int):
        if not LEAST_PERCENT <= percent <= 100:
            raise ValueError(f"the index finds similarities of {LEAST_PERCENT} to 100 percent")
        p = percent / 100
        self.percent, self.inner = percent, 2 * p - 1 - 0.15
        self.halo_same = int(VALUES * self.inner - 2.2 * (VALUES * self.inner * (1 - self.inner)) ** 0.5)
        covered = self.inner + 1 - p
        self.covered_apart = (1 - covered) / (1 + covered)
        #: linked: the symmetric difference is at most this share of the sum of the sizes
        self.apart = (1 - p) / (1 + p)
        self.halo_apart = (1 - self.inner) / (1 + self.inner)


def central_hubs(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id, hub) for each key that several classes have, and (id, home) for each class with such a key."""
    several = chunk_keys(classes).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = chunk_keys(classes).join(several.select(F.struct("key").alias("of"), "n"), F.struct("key") == F.col("of")).select("key", "id", "n")
    shared = materialize(shared, "keys")
    central = shared.groupBy("id").agg(F.sum("n").alias("fame"))
    famed = materialize(shared.select("key", "id").join(central, "id"), "fame")
    top = famed.groupBy("key").agg(F.max(F.struct("fame", (-F.col("id")).alias("least"))).alias("top"))
    keyed = famed.join(top.select(F.struct("key").alias("of"), "top"), F.struct("key") == F.col("of")).select("key", "id", "top")
    keyed = materialize(keyed, "hubs")
    homes = keyed.groupBy("id").agg((-F.max("top")["least"]).alias("home"))
    return keyed.select("key", "id", (-F.col("top.least")).alias("hub")), homes


def _near_hubs(pairs: DataFrame, classes: DataFrame, bounds: Bounds, signed: bool) -> DataFrame:
    """The pairs (id, hub) that may be as similar as a halo by their sizes, and if signed, by their signatures too."""
    pairs = pairs.filter("id <> hub").join(classes.select("id", F.struct("n_shingles", *LANES).alias("a")), "id").select("id", "hub", "a")
    pairs = pairs.join(classes.select(F.col("id").alias("hub"), F.struct("n_shingles", *LANES).alias("b")), "hub")
    near = pairs.filter(F.least("a.n_shingles", "b.n_shingles") / F.greatest("a.n_shingles", "b.n_shingles") >= bounds.inner)
    return (near.filter(F.expr(_AGREEMENT) >= bounds.halo_same) if signed else near).select("id", "hub")


def _within(bounds: Bounds) -> str:
    """SQL: may the classes a and b be linked, by their sizes and the distance of their signatures?"""
    sizes = f"100 * least(a.n_shingles, b.n_shingles) >= {bounds.percent} * greatest(a.n_shingles, b.n_shingles)"
    return f"{sizes} and {_AGREEMENT} >= {VALUES - MOST_DIFFERENT}"


def _open_keys(keyed: DataFrame, state: DataFrame) -> DataFrame:
    """(key, id, hub, comp) of the keys with classes of several components, but for those whose
    classes are all near one home; state: id, comp, home, at_home."""
    members = keyed.join(state, "id")
    keys = members.groupBy("key").agg(*(f(c).alias(f"{n}_{c}") for c in ("comp", "home") for n, f in (("low", F.min), ("top", F.max))), F.bool_and("at_home").alias("all_home"))
    keys = keys.filter("low_comp <> top_comp and not (low_home = top_home and all_home)").select(F.struct("key").alias("of"))
    return members.join(keys, F.struct("key") == F.col("of")).select("key", "id", "hub", "comp")


def _strays(rows: DataFrame, compared: DataFrame, texts: DataFrame, words: int, bounds: Bounds) -> DataFrame:
    """(a, b): classes of open keys and different components that may be similar, of which at least one is not near
    the hub of a key; rows: key, id, hub, comp.

    Two classes near a key's hub have deltas to it, and what links to a class well within the
    halo is near; so neither of these is left out. The rest meet by prefixes of their
    shingles, the rarest among them first: similar sets have one of each other's prefix, and
    behind the first common place room for the overlap that they need.
    """
    near = compared.filter("close").select(F.col("a").alias("id"), F.col("b").alias("hub"), "covered")
    left = rows.filter("id <> hub").join(near, ["id", "hub"], "left").select("key", "id", "comp", F.col("covered").isNull().alias("far"), F.coalesce("covered", F.lit(False)).alias("covered"))
    left = left.filter("not covered")
    several = left.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("top"), F.bool_or("far").alias("any_far")).filter("low <> top and any_far").select(F.struct("key").alias("of"))
    left = left.join(several, F.struct("key") == F.col("of")).groupBy("id").agg(F.first("comp").alias("comp"), F.bool_or("far").alias("far"))

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashed = WordHashes()
        for batch in in_slices(batches):
            found = [shingle_set(hashed(words_of(t)), words).view(np.int64) for t in byte_texts(batch.column("text"))]
            columns = [batch.column("id"), batch.column("comp"), batch.column("far"), pa.array([len(f) for f in found], pa.int32()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "comp", "far", "size", "shingles"])

    left = materialize(left.join(texts, "id").select("id", "comp", "far", "text").mapInArrow(sets, "id long, comp long, far boolean, size int, shingles array<long>"), "strays")
    counts = left.sparkSession.sparkContext.broadcast(_bucket_counts(left))

    def prefixes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, places, found = [], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            for i, own in enumerate(batch.column("shingles")):
                own = own.values.to_numpy()
                length = len(own) - -(-bounds.percent * len(own) // 100) + 1
                found.append(own[np.lexsort([own, counts.value[_bucket(own)]])][:length])
                places.append(np.arange(1, length + 1, dtype=np.int32))
                rows += [i] * length
            columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("id", "comp", "far", "size")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(places)), pa.array(np.concatenate(found))], names=["id", "comp", "far", "size", "place", "shingle"])

    places = materialize(left.mapInArrow(prefixes, "id long, comp long, far boolean, size int, place int, shingle long"), "prefixes")
    other = places.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("id", "comp", "far", "size", "place")))
    room = f"{100 + bounds.percent} * (1 + least(size - place, size_b - place_b)) >= {bounds.percent} * (size + size_b)"
    pairs = places.join(other, "shingle").filter(f"id < id_b and comp <> comp_b and (far or far_b) and {room}")
    return pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _bucket_counts(sets: DataFrame) -> np.ndarray:
    """In how many sets the shingles of each bucket are, a table of fixed size. It tells common shingles from rare ones;
    any order that is the same for all sets gives right prefixes."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_bucket(batch.column("shingles").flatten().to_numpy()), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    summed = sets.select("shingles").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


COMPARED = "a long, b long, linked boolean, close boolean, covered boolean, delta array<long>, prefix int, own int"


def _compare(pairs: DataFrame, texts: DataFrame, words: int, bounds: Bounds) -> DataFrame:
    """COMPARED for each pair (a, b): are the full sets similar, are they as similar as a halo
    and well within it, and if so what sets a apart from b, its own shingles first, how much of that is its prefix, and the size of a's set.
    """
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashed, last, hub = WordHashes(), None, None
        for batch in in_slices(batches):
            linked, close, covered, deltas, prefixes, sizes = [], [], [], [], [], []
            for b, one, other in zip(batch.column("b").to_pylist(), byte_texts(batch.column("text_a")), byte_texts(batch.column("text_b")), strict=True):
                if b != last:
                    last, hub = b, shingle_set(hashed(words_of(other)), words)
                own = shingle_set(hashed(words_of(one)), words)
                added, gone = np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)
                delta, both = len(added) + len(gone), len(own) - len(added)
                linked.append(100 * both >= bounds.percent * (len(added) + len(hub)))
                close.append(delta <= bounds.halo_apart * (len(own) + len(hub)))
                covered.append(delta <= bounds.covered_apart * (len(own) + len(hub)) - 1e-6)
                deltas.append(np.concatenate([added, gone]).view(np.int64) if close[-1] else [])
                need = int((delta + bounds.apart * (len(hub) - len(own))) // 2) + 1
                prefixes.append(max(delta - need + 1, 0))
                sizes.append(len(own))
            columns = [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(close, pa.bool_()), pa.array(covered, pa.bool_()), pa.array(deltas, pa.list_(pa.int64())), pa.array(prefixes, pa.int32()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "linked", "close", "covered", "delta", "prefix", "own"])

    return both.mapInArrow(compare, COMPARED)


def _by_delta(compared: DataFrame, comps: DataFrame, bounds: Bounds) -> DataFrame:
    """(a, b): classes of one hub's halo and of different components that may be similar.

    With x not linked to the hub, a link of x and y needs more common elements of their deltas
    than half of y's delta (corrected for sizes), so x's delta has one of y's prefix. An element
    that no such x has fills the prefix first, then those that the fewest have. Behind the first
    common element, both deltas must have room for the overlap that the two sizes need.
    """
    halo = with_components(compared.filter("close"), comps)
    settled = F.col("linked") | (F.col("comp_a") == F.col("comp_b"))
    halo = materialize(halo.select("b", "a", "comp_a", settled.alias("settled"), "prefix", "own", F.size("delta").alias("size"), "delta").toDF("hub", "y", "comp", "settled", "prefix", "own", "size", "delta"), "halo")
    parts = halo.select(*halo.columns[:-1], F.explode("delta").alias("element"))
    counts = parts.filter("not settled").groupBy("hub", "element").agg(F.count(F.lit(1)).alias("n"))
    found = parts.join(counts, ["hub", "element"]).groupBy(*halo.columns[:-1]).agg(F.array_sort(F.collect_list(F.struct("n", "element"))).alias("met"))
    found = found.select("*", F.posexplode("met").alias("i", "one"))
    places = found.select("hub", "y", "comp", "settled", "prefix", "own", "size", (F.col("size") - F.size("met") + F.col("i") + 1).alias("place"), F.col("one.element").alias("element"))
    places = materialize(places.filter("place <= prefix or not settled"), "places")
    x = places.filter("not settled").select("hub", "element", *(F.col(c).alias(f"{c}_x") for c in ("y", "comp", "own", "size", "place")))
    room = 2 * (1 + F.least(F.col("size") - F.col("place"), F.col("size_x") - F.col("place_x")))
    enough = room >= F.col("size") + F.col("size_x") - bounds.apart * (F.col("own") + F.col("own_x")) - 1e-6
    met = x.join(places.filter("place <= prefix"), ["hub", "element"]).filter((F.col("comp_x") != F.col("comp")) & (F.col("y_x") != F.col("y")) & enough)
    return met.select(F.least("y_x", "y").alias("a"), F.greatest("y_x", "y").alias("b")).distinct()


def with_components(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """pairs (a, b) with comp_a and comp_b; comps: id, comp."""
    for side in ("a", "b"):
        pairs = pairs.join(comps.select(F.col("id").alias(side), F.col("comp").alias(f"comp_{side}")), side)
    return pairs


def _components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """uid, doc_id, n_shingles, component_id and stays (is it the row with the smallest doc_id of its component?)
    for each row of docs (uid, doc_id, text)."""
    bounds = Bounds(percent)
    rows = materialize(signatures(docs, words), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "uid")
    classes = rows.filter("n_shingles > 0").groupBy("same", "n_shingles", *LANES).agg(F.min("uid").alias("id"), F.min(first).alias("first"))
    classes = materialize(classes, "classes")
    narrow = classes.select("id", "n_shingles", *LANES)
    keyed, homes = central_hubs(narrow)
    homes = materialize(homes, "homes")
    texts = materialize(docs.select(F.col("uid").alias("id"), "text").join(homes.select("id"), "id"), "texts")

    # each class against its home
    pairs = _near_hubs(homes.select("id", F.col("home").alias("hub")), narrow, bounds, True).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    at_home = materialize(_compare(pairs, texts, words, bounds), "at-home")
    linked = connected_components(at_home.filter("linked").select("a", "b"))
    state = homes.join(linked, "id", "left").join(at_home.select(F.col("a").alias("id"), "close"), "id", "left")
    state = materialize(state.select("id", "home", F.coalesce("comp", "id").alias("comp"), ((F.col("id") == F.col("home")) | F.coalesce("close", F.lit(False))).alias("at_home")), "state")
    comps = state.select("id", "comp")

    let_go(docs.sparkSession)

    # keys that this leaves open
    left = materialize(_open_keys(keyed, state), "open")
    of_hub = _near_hubs(left.select("id", "hub").distinct(), narrow, bounds, False).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    of_hub = of_hub.join(at_home.select("a", "b"), ["a", "b"], "left_anti")
    compared = materialize(_compare(of_hub, texts, words, bounds), "compared")
    strays = _strays(left, at_home.union(compared), texts, words, bounds)
    met = strays.union(_by_delta(at_home.union(compared), comps, bounds)).distinct()
    met = met.join(narrow.select(F.col("id").alias("a"), F.struct("n_shingles", *LANES).alias("one")), "a").join(narrow.select(F.col("id").alias("b"), F.struct("n_shingles", *LANES).alias("other")), "b")
    met = met.select(F.struct("a", "one.*").alias("a"), F.struct("b", "other.*").alias("b")).filter(_within(bounds)).select("a.a", "b.b")
    more = _compare(materialize(met, "met"), texts, words, bounds)
    let_go(docs.sparkSession)
    links = compared.filter("linked").select("a", "b").union(more.filter("linked").select("a", "b"))
    between = with_components(links, comps).filter("comp_a <> comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    last = connected_components(between).select(F.col("id").alias("comp"), F.col("comp").alias("joined"))
    comps = comps.join(last, "comp", "left").select("id", F.coalesce("joined", "comp").alias("comp"))

    members = classes.select("same", "id", "first").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    lows = members.groupBy("comp").agg(F.min("first").alias("low"))
    members = members.join(lows.select(F.struct("comp").alias("of"), "low"), F.struct("comp") == F.col("of")).select(F.struct("same").alias("as"), "low")
    out = rows.join(members, (F.struct("same") == F.col("as")) & (F.col("n_shingles") > 0), "left")
    return out.select("uid", "doc_id", "n_shingles", F.coalesce("low.doc_id", "doc_id").alias("component_id"), F.coalesce(F.col("uid") == F.col("low.uid"), F.lit(True)).alias("stays"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Links documents with 100 * intersection >= percent * union of their shingle sets.
    """
    ship(docs.sparkSession)
    own, uid = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = _components(own.select(F.col(uid).alias("uid"), "doc_id", "text"), words, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs, with all their columns, with one row of each component: that with the smallest doc_id, of equal ones any one.

    Rows are told apart by a number of their own, so null and repeated ids do no harm.
    """
    ship(docs.sparkSession)
    own, uid = numbered(docs)
    found = _components(own.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), words, percent)
    return without(own, uid, found.filter("not stays"), "gone").select(*docs.columns)
