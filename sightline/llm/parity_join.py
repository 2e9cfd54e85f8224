"""N-gram Jaccard join by parity sketches.

Two sets with Jaccard similarity of at least 0.8 and sizes a, b differ in at most (a + b)/9
elements. Sizes fall into bands [2^i, 2^(i+1)); in a band any such pair differs in at most d
elements. The elements of a set are dealt into k > d blocks by hash, and each block is sketched by
the XOR of its elements' hashes: sets that differ in at most d elements differ in at most d block
sketches, so one of any d + 1 blocks agrees. A set sends the sketches of its first d + 1 non-empty
blocks: before the first block in which two sets agree each has at most d others, so both send it.
What meets is compared. A set is also sketched for the band below if a partner may be there.

Very common shingles (a bounded table, found on a sample of documents) are left out of the sketches:
that only lowers the difference, so the bound holds for any such table. A set that then has d
non-empty blocks or fewer is sketched a second time with all its shingles, and, if still too few, its
empty blocks take part among sets of that kind. The table changes speed alone, never the result.

Equal sets are folded first. Within a block's group every member is compared with one pivot, so a
group of copies costs one comparison per member; what a group then holds beside its largest component
is compared with the whole group's components, tile by tile. Both compare bit sketches (parity of the
elements hashed to each bit) and verify on the sets what these allow. Sets are 64-bit shingle hashes.

Defined results: null and empty texts have an empty set and link with nothing; fewer words than a
shingle make one shingle; rows that share an id keep a set and a component each; a null id links with
nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.components import components
from sightline.llm.registry import query
from sightline.llm.words import mixed, shingles
from sightline.session import store

WORDS = 5
#: The common shingles: at most so many, seen in so many of so many sampled documents.
COMMON, COMMON_DOCS, SAMPLE_DOCS = 200_000, 4, 5_000
#: Members of a group that are kept in memory to tell equal groups apart.
HELD = 65_536


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def set_hashes(grams: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit hashes of a set."""
    a, b = mixed(grams, 1).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(grams, 2))
    size = np.uint64(len(grams))
    return tuple(int(mixed(np.array([v + size]))[0].view(np.int64)) for v in (a, b))


def band_of(size: int) -> int:
    return size.bit_length() - 1


def most_different(band: int) -> int:
    """Greatest difference of a pair whose smaller set is in ``band``: sizes a and at most 1.25 a."""
    return ((2 << band) - 1) // 4


def block_count(band: int) -> int:
    differ = most_different(band)
    return differ + 1 if differ == 0 else (3 * (differ + 1) + 1) // 2


def block_sketches(grams: np.ndarray, band: int, space: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, numbers) of the non-empty blocks of a set in a band."""
    blocks = block_count(band)
    block = (mixed(grams, 3 + band) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, grams = block[order], grams[order]
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else block
    own = block[starts]
    place = (np.uint64(band) << np.uint64(40)) + (np.uint64(space) << np.uint64(36))
    parity = np.bitwise_xor.reduceat(mixed(grams, 4), starts) if len(starts) else np.zeros(0, np.uint64)
    return mixed(parity ^ mixed(own.astype(np.uint64) + place)), own


def empty_keys(own: np.ndarray, band: int) -> np.ndarray:
    """Keys of the blocks other than ``own``."""
    empty = np.setdiff1d(np.arange(block_count(band)), own)
    return mixed(empty.astype(np.uint64) + (np.uint64(band) << np.uint64(40)), 5)


def sketch_keys(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """All join keys of a set."""
    size, out = len(grams), []
    rare = grams
    if len(common):
        rare = grams[common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] != grams]
    band = band_of(size)
    for at in (band, band - 1) if band and size < 1.25 * (1 << band) else (band,):
        need = most_different(at) + 1
        if need == 1:  # only equal sets
            continue
        keys, _ = block_sketches(rare, at, 0)
        out.append(keys[:need])
        if len(keys) < need:
            keys, own = block_sketches(grams, at, 1)
            out.append(keys[:need])
            if len(keys) < need:
                out.append(empty_keys(own, at))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Small slices with their texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part, part.column(column).to_pylist()


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """(id, mark, n, member, check, bits) per row: the set's size, two hashes and bit sketch."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches):
            sets = [shingles(text, size) for text in values]
            hashes = [set_hashes(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()),
                    pa.array([bit_sketch(s) if len(s) else None for s in sets], pa.binary()),
                ],
                ["id", "mark", "n", "member", "check", "bits"],
            )

    mark = docs.schema["mark"].dataType.simpleString()
    return docs.mapInArrow(
        describe, f"id long, mark {mark}, n long, member long, check long, bits binary"
    )


def common_shingles(docs: DataFrame, total: int, size: int) -> np.ndarray:
    """Shingles seen in several documents of a sample; sorted."""
    share = min(1.0, SAMPLE_DOCS / max(1, total))
    picked = docs.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values in texts(batches):
            sets = [shingles(text, size) for text in values]
            found, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(found), pa.array(times)], ["gram", "n"])

    counted = picked.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= COMMON_DOCS).orderBy(F.col("n").desc(), "gram").limit(COMMON)
    return np.sort(top.select("gram").toPandas()["gram"].to_numpy(np.int64).view(np.uint64))


def groups_of(docs: DataFrame, common: np.ndarray, size: int) -> DataFrame:
    """(sig, member): members that share a block sketch; equal groups appear once."""
    known = docs.sparkSession.sparkContext.broadcast(common)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task are sketched once
        for _, values in texts(batches):
            out, members = [], []
            for text in values:
                grams = shingles(text, size)
                if not len(grams):
                    continue
                member = set_hashes(grams)[0]
                if member in seen:
                    continue
                if len(seen) >= HELD:
                    seen.clear()
                seen.add(member)
                own = sketch_keys(grams, known.value)
                out.append(own)
                members.append(np.full(len(own), member, np.int64))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate(out)), pa.array(np.concatenate(members))], ["key", "member"]
                )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sig", "member"]

        def closed(key: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
            """Groups of two and more of whole runs, named by their members."""
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (member[1:] != member[:-1])])
            key, member = key[new], member[new]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            length = np.diff(np.append(first, len(key)))
            sums = np.add.reduceat(mixed(member.view(np.uint64), 6), first)
            sig = np.repeat(mixed(sums + length.astype(np.uint64)), length)
            many = np.repeat(length, length) > 1
            return pa.RecordBatch.from_arrays([signed(sig[many]), pa.array(member[many])], names)

        held_key, held_member, long = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            key, member = batch.column("key").to_numpy(), batch.column("member").to_numpy()
            if long:  # inside a run too long to hold: it is named by its key
                same = int(np.searchsorted(key != held_key[0], True))  # keys come sorted
                yield pa.RecordBatch.from_arrays([pa.array(key[:same]), pa.array(member[:same])], names)
                if same == len(key):
                    continue
                key, member, held_key, held_member, long = key[same:], member[same:], key[:0], member[:0], False
            key, member = np.concatenate([held_key, key]), np.concatenate([held_member, member])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield closed(key[:last], member[:last])
            held_key, held_member = key[last:], member[last:]
            if len(held_key) > HELD:
                long = True
                yield pa.RecordBatch.from_arrays([pa.array(held_key), pa.array(held_member)], names)
        if not long and len(held_key):
            yield closed(held_key, held_member)

    sketched = docs.mapInArrow(keys, "key long, member long")
    return (
        sketched.repartition("key").sortWithinPartitions("key", "member")
        .mapInArrow(runs, "sig long, member long").distinct()
    )


def exactly(percent: int):
    """Test of two sets given as sorted shingle hashes."""

    def test(x: bytes, y: bytes, *_) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    return test


def by_sketch(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Whether sets with these bit sketches and sizes can be linked."""
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    x, y = (np.frombuffer(v, np.uint64)[None] for v in (x, y))
    words = min(x.shape[1], y.shape[1])
    return 9 * int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= n + m


def passing(pairs: DataFrame, sets: DataFrame, column: str, test, spread: int = 256) -> DataFrame:
    """The pairs (a, b) of members for which ``test`` holds on a column (and ``n``) of their ``sets``.

    The sets that meet one pivot are dealt over as many tasks as their number asks for.
    """
    sets = sets.select("member", "n", F.col(column).alias("data"))
    slots = pairs.groupBy("a").agg((F.floor(F.count("*") / spread) + 1).alias("slots"))
    dealt = pairs.join(slots, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("slots")).alias("slot"))
    others = dealt.join(sets, dealt.b == sets.member).select(
        "a", "slot", F.lit(1).alias("role"), "b", "n", "data"
    )
    pivots = slots.join(sets, slots.a == sets.member).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"),
        F.lit(0).alias("role"), F.col("a").alias("b"), "n", "data",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size, now = None, 0, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("a", "slot", "role", "b", "n")]
            data = batch.column("data")
            for row, (a, slot, role, b, n) in enumerate(zip(*columns)):
                if role == 0:
                    own, size, now = data[row].as_py(), n, (a, slot)
                elif now == (a, slot) and test(own, data[row].as_py(), size, n):
                    out.append((a, b))
            a, b = zip(*out) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return (
        pivots.unionByName(others).repartition("a", "slot").sortWithinPartitions("a", "slot", "role", "b")
        .mapInArrow(run, "a long, b long")
    )


def linked(docs: DataFrame, pairs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, by exact intersection."""
    pairs = store(pairs, "to-verify")
    asked = pairs.select(F.col("a").alias("member")).union(pairs.select("b")).distinct()
    # its true size decides how it is joined with the texts
    wanted = store(
        asked.join(members.select("member", "rep"), "member").select("rep", F.col("member").alias("wanted")),
        "wanted",
    )

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches):
            sets = [shingles(value, size) for value in values]
            own = [set_hashes(s)[0] if len(s) else None for s in sets]
            keep = [k for k, m in enumerate(part.column("wanted").to_pylist()) if m == own[k]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([own[k] for k in keep], pa.int64()), pa.array([len(sets[k]) for k in keep], pa.int64()),
                    pa.array([sets[k].tobytes() for k in keep], pa.binary()),
                ],
                ["member", "n", "grams"],
            )

    sets = docs.join(wanted, docs.id == wanted.rep).select("wanted", "text").mapInArrow(
        sets_of, "member long, n long, grams binary"
    )
    return store(passing(pairs, store(sets, "verify-sets"), "grams", exactly(percent)).distinct(), "links")


def bit_sketch(grams: np.ndarray) -> bytes:
    """The parity of the elements hashed to each bit: a power of two of bits, at least 8 an element."""
    bits = max(64, 1 << (8 * len(grams) - 1).bit_length())
    odd = np.bincount((mixed(grams, 7) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches over fewer bits: bit i of the short one is the parity of the long one's i modulo it."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def may_link(
    member: np.ndarray, root: np.ndarray, size: np.ndarray, bits: list[bytes],
    left: np.ndarray, right: np.ndarray,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in left and right) whose sketches differ in no more bits than linked sets may."""
    widths = np.fromiter(map(len, bits), np.int64, len(bits)) // 8

    def stacked(places: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join([bits[p] for p in places]), np.uint64).reshape(len(places), -1)

    for wide in np.unique(widths[left]):
        some = left[widths[left] == wide]
        for other in np.unique(widths[right]):
            if not wide <= 2 * other <= 4 * wide:  # sizes are too far apart
                continue
            rest = right[widths[right] == other]
            words = min(wide, other)
            x, y = folded(stacked(some), words), folded(stacked(rest), words)
            step = max(1, (1 << 21) // (words * len(y)))
            for at in range(0, len(x), step):
                part = some[at : at + step]
                differ = np.bitwise_count(x[at : at + step, None, :] ^ y[None]).sum(axis=2, dtype=np.int64)
                n, m = size[part][:, None], size[rest]
                fine = (9 * differ <= n + m) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
                fine &= root[part][:, None] != root[rest]
                i, j = np.nonzero(fine)
                yield part[i], rest[j]


def open_pairs(groups: DataFrame, sets: DataFrame, roots: DataFrame, tile: int = 512) -> DataFrame:
    """Pairs of different components that share a group and whose bit sketches allow a link.

    Each group is led by its largest component; every other component of the group is a guest of
    that one. Guests are compared with the hosts and with each other, tile by tile.
    """
    members = store(
        sets.join(roots.withColumnRenamed("node", "member"), "member", "left").select(
            "member", F.coalesce("root", "member").alias("root"), "n", "bits"
        ),
        "members",
    )
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    placed = groups.select("sig", "member").join(members.select("member", "root"), "member").select(
        "sig", "root"
    ).distinct()
    led = placed.join(sizes, "root").groupBy("sig").agg(
        F.max(F.struct("size", "root")).alias("lead"), F.count("*").alias("parts")
    ).filter("parts > 1").select("sig", F.col("lead.root").alias("lead"))
    guests = store(
        placed.join(led, "sig").filter("root <> lead").select("lead", "root").distinct(), "guests"
    )
    hosts = guests.select("lead", F.col("lead").alias("root")).distinct()
    met = guests.withColumn("guest", F.lit(True)).union(hosts.withColumn("guest", F.lit(False))).join(
        members.select("member", "root"), "root"
    )
    blocks = met.groupBy("lead").agg(
        (F.floor(F.count_if("guest") / tile) + 1).alias("guest_blocks"),
        (F.floor(F.count_if(~F.col("guest")) / tile) + 1).alias("host_blocks"),
    )
    dealt = met.join(blocks, "lead").withColumn(
        "part", F.pmod(F.xxhash64("member"), F.when(F.col("guest"), F.col("guest_blocks")).otherwise(F.col("host_blocks")))
    )
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    other = F.col("other")
    tiles = dealt.filter("guest").select("*", F.explode(upto("guest_blocks")).alias("other")).select(
        "lead", F.least("part", other).alias("i"), F.greatest("part", other).alias("j"),
        F.lit(True).alias("guests"), (F.col("part") <= other).alias("is_left"), "member", "root",
    ).union(
        dealt.filter("guest").select("*", F.explode(upto("host_blocks")).alias("other")).select(
            "lead", "part", "other", F.lit(False), F.lit(True), "member", "root"
        )
    ).union(
        dealt.filter(~F.col("guest")).select("*", F.explode(upto("guest_blocks")).alias("other")).select(
            "lead", "other", "part", F.lit(False), F.lit(False), "member", "root"
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come tile by tile; a tile's rows (two blocks at most) are held together."""
        held: list[pa.RecordBatch] = []

        def closed() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            member, root, size = (rows.column(c).to_numpy() for c in ("member", "root", "n"))
            is_left = rows.column("is_left").to_numpy()
            itself = rows.column("guests")[0].as_py() and rows.column("i")[0] == rows.column("j")[0]
            left = np.arange(len(member)) if itself else np.flatnonzero(is_left)
            right = left if itself else np.flatnonzero(~is_left)
            for i, j in may_link(member, root, size, rows.column("bits").to_pylist(), left, right):
                a, b = np.minimum(member[i], member[j]), np.maximum(member[i], member[j])
                keep = a < b
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

        now = None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("lead", "guests", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if now is not None and (keys[:, start] != now).any():
                    yield from closed()
                    held = []
                now = keys[:, start]
                held.append(batch.slice(start, end - start))
        if held:
            yield from closed()

    tile_key = ["lead", "guests", "i", "j"]
    return (
        tiles.join(members.select("member", "n", "bits"), "member")
        .repartition(*tile_key).sortWithinPartitions(*tile_key).mapInArrow(compare, "a long, b long").distinct()
    )


def jaccard_components(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = WORDS, percent: int = 80,
    mark: Column | None = None,
) -> DataFrame:
    """(id, mark, n_shingles, component_id, class) per row: components of the links at ``percent``
    or more.

    ``mark`` is carried through, to tell rows apart that share an id; ``class`` tells components
    apart that share their smallest id (null for rows that link with nothing by rule). The band and block sizes are those of 80 percent; a higher ``percent`` only filters more.
    """
    if percent < 80:
        raise ValueError("the sketches are sized for 80 percent and more")
    mark = F.lit(None).cast("int") if mark is None else mark
    marked = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), mark.alias("mark"))
    docs = marked.drop("mark")
    described = store(set_table(marked, size), "sets")
    total = described.count()
    known = described.filter(F.col("id").isNotNull() & F.col("member").isNotNull())
    common = common_shingles(docs, total, size)
    groups = store(groups_of(docs.filter(F.col("id").isNotNull()), common, size), "groups")
    # one row stands for all rows of a set
    members = store(
        known.join(groups.select("member").distinct(), "member", "left_semi").groupBy("member").agg(
            F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")
        ),
        "candidates",
    )
    pivots = groups.groupBy("sig").agg(F.min("member").alias("pivot"))
    stars = groups.join(pivots, "sig").filter("pivot <> member").select(
        F.col("pivot").alias("a"), F.col("member").alias("b")
    ).distinct()
    links = linked(docs, passing(stars, members, "bits", by_sketch), members, size, percent)
    roots = store(components(links), "roots")
    rest = open_pairs(groups, members, roots)
    roots = store(components(links.union(linked(docs, rest, members, size, percent))), "roots")
    nodes = known.groupBy("member", "check").agg(F.min("id").alias("least")).join(
        roots.withColumnRenamed("node", "member"), "member", "left"
    ).withColumn("root", F.coalesce("root", "member"))
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_member = nodes.join(names, "root").groupBy("member").agg(
        F.min(F.struct("component_id", "root")).alias("found")
    )
    return described.join(by_member, "member", "left").select(
        "id", "mark", F.col("n").alias("n_shingles"),
        F.coalesce("found.component_id", "id").alias("component_id"),
        F.when(F.col("id").isNotNull(), F.col("found.root")).alias("class"),
    )


@query("op6_parity_join", "documents", sql=r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3),
                                    lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
    n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
    e AS (SELECT doc_id, unnest(g) AS g FROM s),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
          GROUP BY ALL),
    l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)),
    d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT d.b, r.c FROM r JOIN d ON d.a = r.doc_id)
    SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id
    FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n
""")
def op6(documents: DataFrame) -> DataFrame:
    return jaccard_components(documents).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
