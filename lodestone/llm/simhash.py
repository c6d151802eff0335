"""SimHash near-dedup: fingerprints of word shingles, linked by multi-index hashing, grouped into components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import KEY, components, cut, forget, gathered, row_key, small, table, without
from lodestone.session import in_arrow

SHINGLE, MOST_BITS, SEED = 4, 4, 42
#: Rows of one table bucket beyond which its key is refined by blocks of the other segment.
HOT_BUCKET = 20_000
_HALF = np.uint64(0xFFFFFFFF)
#: The ball of radius 1 of a 32-bit segment, as masks.
_BALL = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(32, dtype=np.uint64)])
#: Five blocks of a 32-bit segment: of two segments that differ in 4 bits at most, one block is equal.
_BLOCKS = [(0, 7), (7, 7), (14, 6), (20, 6), (26, 6)]

#: Near duplicates by similarity: words of a shingle, least Jaccard similarity of the sets of shingles.
WORDS, SIMILAR = 5, 0.8
#: Their fingerprints: four words of 64 bits, cut into segments of so many bits. Texts of that similarity differ in 15 %
#: of all bits or fewer on average; of 13 % one of the segments differs in 1 bit at most for 95 of 100 pairs.
SEGMENT, SEGMENTS = 21, 12
#: Most differing bits of one word of 64, and of all four, of texts that are compared shingle by shingle: more than two and
#: a half standard deviations above that average.
WORD_BITS, ALL_BITS = 17, 54
#: Rows of a bucket that are compared at once with as many others of it; a longer one is gone through in such squares.
STRETCH = 1024
#: Closest candidates of a text that are compared in a round, and the most rounds. In each round a text looks for those
#: that it isn't joined with yet. They join most of what is similar; an exact join of what has candidates finds the rest.
CLOSEST, ROUNDS = 4, 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of ``text``: words between ASCII white space, A-Z lower-cased; no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    hashes = [h(join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))]
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):  # a very long text is counted in pieces
        bits = np.array(hashes[i : i + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(bits, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row of ``docs`` (doc_id, text); fp holds the 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, "doc_id long, fp long")


def _variants(batches):
    """For each half of each fingerprint, the 33 values within 1 bit as table keys. Halves that differ in 2 bits at most
    share a key, and of two fingerprints that differ in 4 bits one half does."""
    for b in batches:
        if not b.num_rows:
            continue
        fp = b.column(0).to_numpy().view(np.uint64)
        for half in (0, 1):
            value = (fp >> np.uint64(32 * half)) & _HALF
            keys = (value[:, None] ^ _BALL[None, :]).ravel()
            n = len(_BALL)
            yield pa.record_batch(
                [pa.array(np.full(len(keys), half, np.int16)), pa.array(keys.view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(b.column(1).to_numpy(), n))],
                ["part", "key", "fp", "node"],
            )


def _refined(batches):
    """Rows of hot buckets, keyed anew by each block of the other half, which has at most 4 bits to differ in."""
    for b in batches:
        fp, key, part = (b.column(i).to_numpy() for i in (2, 1, 0))
        other = (fp.view(np.uint64) >> (np.uint64(32) * (1 - part).astype(np.uint64))) & _HALF
        for i, (at, width) in enumerate(_BLOCKS):
            block = (other >> np.uint64(at)) & np.uint64((1 << width) - 1)
            sub = part.astype(np.int64) + 2 * (1 + i * 128 + block.astype(np.int64))
            yield pa.record_batch([pa.array(sub.astype(np.int16)), b.column(1), b.column(2), b.column(3)], ["part", "key", "fp", "node"])


def _forest(fp: np.ndarray, node: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Edges that join what is linked within one bucket: verified by the whole distance, one fewer than its members at
    most, not all pairs."""
    left, edges, todo = np.arange(1, len(fp)), [], [0]
    while True:
        if not todo:
            if not len(left):
                return edges
            todo, left = [left[0]], left[1:]
        at = todo.pop()
        near = np.bitwise_count(fp[left] ^ fp[at]) <= most_bits
        for i in left[near]:
            edges.append((int(node[at]), int(node[i])))
            todo.append(i)
        left = left[~near]


def _links(most_bits: int):
    def run(batches):
        """Rows come sorted by bucket; a bucket that a batch cuts off is carried over to the next."""
        rest = None
        for b in batches:
            part, key, fp, node = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if rest is not None:
                part, key, fp, node = (np.concatenate(x) for x in zip(rest, (part, key, fp, node), strict=True))
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            last = starts[-1]
            rest = tuple(x[last:] for x in (part, key, fp, node))
            yield from pairs(starts, fp.view(np.uint64), node)
        if rest is not None and len(rest[0]) > 1:
            yield from pairs(np.array([0, len(rest[0])]), rest[2].view(np.uint64), rest[3])

    def pairs(starts, fp, node):
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= most_bits]
        found = list(zip(node[near].tolist(), node[near + 1].tolist(), strict=True))
        for at, n in zip(starts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            found += _forest(fp[at : at + n], node[at : at + n], most_bits)
        if found:
            a, b = np.array(found, np.int64).T
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def links(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Edges (a, b) of nodes that connect just what the links of ``most_bits`` (4 at most) or fewer differing bits
    connect. ``fps`` (fp, node) has each fingerprint once.

    Each of two 32-bit segments enumerates its ball of radius 1; equal values meet in a bucket of the table of that
    segment. A bucket of over HOT_BUCKET rows is refined by blocks of the other segment: exact all the same.
    """
    if not 0 <= most_bits <= 4:
        raise ValueError("two segments with balls of radius 1 on both sides find distances of up to 4")
    rows = in_arrow(fps, _variants, "part short, key long, fp long, node long")
    at_most = fps.select(F.explode(F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))).alias("v")).groupBy("v").count().agg(F.max("count")).first()[0]
    if (at_most or 0) * len(_BALL) > HOT_BUCKET:  # else no bucket can hold that many
        hot = cut(rows.groupBy("part", "key").count().where(F.col("count") > HOT_BUCKET).select(F.col("part").alias("p"), F.col("key").alias("k")))
        same = (F.col("part") == F.col("p")) & (F.col("key") == F.col("k"))
        hot = small(hot)
        rows = rows.join(hot, same, "left_anti").union(in_arrow(rows.join(hot, same, "left_semi"), _refined, rows.schema))
    dealt = rows.repartition("part", "key").sortWithinPartitions("part", "key")
    return in_arrow(dealt, _links(most_bits), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``; extra columns are ignored.

    Null and blank texts have fingerprint 0 and link like any other. Rows that repeat are all returned. Equal
    fingerprints are one node, named by its least doc_id, however many rows share it. A row with a null doc_id takes the
    component of the documents with its fingerprint, null if there are none. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, shingle))
    nodes = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes, most_bits))
    roots = nodes.join(found, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "node").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(roots, F.col("fp") == F.col("_fp"), "left").select("doc_id", hexed, "component_id")


def shingle_hashes(text: str | None, size: int = WORDS) -> np.ndarray:
    """XXH64 of each run of ``size`` words (fewer words: of all; none: no hash), words as in :func:`fingerprint`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([h(join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))], np.uint64)


def long_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """Four words of 64 bits: SimHashes of the distinct ``shingles``, remixed for each word; no shingles give zeros."""
    shingles, out = np.unique(shingles), np.zeros(4, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(4 if len(shingles) else 0):
            x = (shingles + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(32)
            ones = np.zeros(64, np.int64)
            for i in range(0, len(x), 65536):  # a very long text is counted in pieces
                ones += np.unpackbits(x[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            out[k] = int.from_bytes(np.packbits(2 * ones > len(x)).tobytes(), "big")
    return out


def _long_fingerprints(batches):
    """Of each text two digests of its words and the four words of its fingerprint; the columns before it pass."""
    names = [*KEY, "doc_id", "t1", "t2", "f0", "f1", "f2", "f3"]
    for b in batches:
        out = []
        for t in b.column(4).to_pylist():
            said = b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())
            d = xxhash.xxh3_128_intdigest(said)
            out.append([d >> 64, d & (2**64 - 1), *long_fingerprint(shingle_hashes(t)).tolist()])
        columns = np.array(out, np.uint64).reshape(-1, 6).view(np.int64).T
        yield pa.record_batch([*(b.column(i) for i in range(4)), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names)


def _segment(f: list[np.ndarray], i: int) -> np.ndarray:
    """Bits of segment ``i`` of fingerprints of four words."""
    word, at = divmod(SEGMENT * i, 64)
    value = f[word] >> np.uint64(at)
    if at + SEGMENT > 64:
        value = value | (f[word + 1] << np.uint64(64 - at))
    return value & np.uint64((1 << SEGMENT) - 1)


def _ball_rows(batches):
    """For each segment of each fingerprint its value and those within 1 bit as table keys, with a word of the
    fingerprint from elsewhere, and the node with the place of the changed bit (0: none) in its lowest 5 bits."""
    masks = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(SEGMENT, dtype=np.uint64)])
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            node, f = part.column(0).to_numpy(), [part.column(k).to_numpy().view(np.uint64) for k in range(1, 5)]
            marked = ((node[:, None] << 5) | np.arange(len(masks))[None, :]).ravel()
            rest = [pa.array(np.repeat(part.column(5).to_numpy(), len(masks)))] if part.num_columns > 5 else []
            for i in range(SEGMENTS):
                keys = ((_segment(f, i)[:, None] ^ masks[None, :]) | np.uint64(i << 32)).ravel()
                word = f[(SEGMENT * i // 64 + 2) % 4].view(np.int64)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.repeat(word, len(masks))), pa.array(marked), *rest], ["key", "word", "marked", "root"][: 3 + len(rest)])


def _nearest(key: np.ndarray, word: np.ndarray, marked: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows of whole buckets: for each node in the bucket of its own segment (none of its bits changed) the
    closest one by its word, of those within WORD_BITS that have another root."""
    own, x, y, d = marked & 31 == 0, [], [], []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        bits = np.bitwise_count(word[i] ^ word[j])
        near = (bits <= WORD_BITS) & (root[i] != root[j])
        for of, to in ((i, j), (j, i)):
            ok = near & own[of]
            x.append(of[ok]), y.append(to[ok]), d.append(bits[ok])

    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    short = np.repeat(sizes <= 16, sizes)
    for step in range(1, min(16, int(sizes[sizes <= 16].max(initial=1)))):
        i = np.flatnonzero((key[step:] == key[:-step]) & short[step:])
        take(i, i + step)
    for start, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        rows = np.arange(start, start + size)
        mine = rows[own[rows]]
        if not len(mine) or (root[rows] == root[start]).all():
            continue
        for i in np.split(mine, range(STRETCH, len(mine), STRETCH)):
            least, best = np.full(len(i), 255, np.uint8), i.copy()
            for j in np.split(rows, range(STRETCH, size, STRETCH)):
                bits = np.bitwise_count(word[i][:, None] ^ word[j][None, :])
                bits[root[i][:, None] == root[j][None, :]] = 255
                at = bits.argmin(1)
                found = bits[np.arange(len(i)), at]
                closer = found < least
                least[closer], best[closer] = found[closer], j[at[closer]]
            ok = least <= WORD_BITS
            x.append(i[ok]), y.append(best[ok]), d.append(least[ok])
    if not x:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y, d = (np.concatenate(v) for v in (x, y, d))
    order = np.lexsort((marked[y], d, x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else x
    return marked[x[first]] >> 5, marked[y[first]] >> 5


def _candidates(batches):
    """(x, y): nodes and their closest candidates. Rows come sorted by key and word; a bucket that a batch cuts off is
    carried over as a whole."""
    rest: list[list[np.ndarray]] = []
    for b in batches:
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        if not len(columns[0]):
            continue
        last = int(np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])[-1])
        if last or (rest and rest[-1][0][-1] != columns[0][0]):
            yield from _found([np.concatenate(v) for v in zip(*rest, [v[:last] for v in columns], strict=True)])
            rest = []
        rest.append([v[last:] for v in columns])
    if rest:
        yield from _found([np.concatenate(v) for v in zip(*rest, strict=True)])


def _found(columns):
    key, word, marked = columns[0], columns[1].view(np.uint64), columns[2]
    if len(key):
        x, y = _nearest(key, word, marked, columns[3] if len(columns) > 3 else marked >> 5)
        if len(x):
            yield pa.record_batch([pa.array(x), pa.array(y)], ["x", "y"])


def _shingle_sets(batches):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            sets = [np.unique(shingle_hashes(t)).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def _sets(texts: DataFrame) -> DataFrame:
    return table(in_arrow(texts, _shingle_sets, "node long, shingles array<long>"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``sets`` of shingles have the similarity."""
    one = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(one("a"), "a").join(one("b"), "b").where(both >= SIMILAR * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    return cut(gathered(found, pairs.count()))


def _unjoined(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with other ``roots`` (node, root) among which all are whose ``sets`` have the similarity.

    A prefix filter, which is exact: shingles are ordered by how many sets have them, rarest first, and of two sets that
    are similar the first fifth, and one, share a shingle. Where that stands in both sets bounds what they can share.
    """
    sized = cut(sets.join(roots, "node").select("node", "root", F.size("shingles").alias("size")))
    each = sets.select("node", F.explode("shingles").alias("s"))
    shared = each.join(sized, "node").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("n > 1")
    listed = each.join(shared.select("s", "n", (F.col("lo") < F.col("hi")).alias("cross")), "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "s", "cross"))).alias("l"))
    listed = listed.join(sized, "node").withColumn("own", F.col("size") - F.size("l"))  # those that it has alone come first
    prefix = F.greatest(F.col("size") - F.ceil(SIMILAR * F.col("size") - 1e-9) + 1 - F.col("own"), F.lit(0)).cast("int")
    rows = listed.select("node", "root", "size", "own", F.slice("l", F.lit(1), prefix).alias("l")).select("node", "root", "size", "own", F.posexplode("l").alias("pos", "e"))
    rows = cut(rows.where("e.cross").select(F.col("e.s").alias("s"), "node", "root", "size", (F.col("size") - F.col("own") - F.col("pos")).alias("left")))
    one = lambda c: rows.select("s", *(F.col(k).alias(k + c) for k in ("node", "root", "size", "left")))
    need = F.ceil(SIMILAR / (1 + SIMILAR) * (F.col("sizea") + F.col("sizeb")) - 1e-9)
    able = (F.least("sizea", "sizeb") >= SIMILAR * F.greatest("sizea", "sizeb") - 1e-9) & (F.least("lefta", "leftb") >= need)
    return one("a").join(one("b"), "s").where((F.col("nodea") < F.col("nodeb")) & (F.col("roota") != F.col("rootb")) & able).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()


def similar_groups(docs: DataFrame) -> DataFrame:
    """(key_id, key_1, key_2, doc_id, node, root), computed once: for each row of ``docs`` (doc_id, text) the node of its
    distinct text and the group of its near duplicates, texts that are linked by a similarity of SIMILAR or more.

    Texts with the same words, between ASCII white space, A-Z lower-cased, are one node, however many rows have them;
    null and blank texts are one. Candidates meet by multi-index hashing: each segment of a long fingerprint enumerates
    its ball of radius 1, and looks up its own value in the table of all. A text takes the closest of each of its buckets,
    by a word of the fingerprints; of these the closest by the whole distance are verified by their shingles. Texts that
    have candidates do so again, among those that they are not joined with, until a round joins nothing or ROUNDS are over.
    So a group of many near copies costs a few comparisons for each of them, not its pairs. What that leaves is found
    exactly: of the texts that have a candidate in any bucket all pairs that are similar and not joined yet.
    """
    rows = cut(in_arrow(docs.select(*row_key(), F.col("doc_id").cast("long"), "text"), _long_fingerprints, "key_id long, key_1 long, key_2 long, doc_id long, t1 long, t2 long, f0 long, f1 long, f2 long, f3 long"))
    prints = [f"f{k}" for k in range(4)]
    sample = F.min(F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("d"), *KEY)).alias("m")  # the row that has the text
    nodes = cut(rows.groupBy("t1", "t2").agg(*(F.min(f).alias(f) for f in prints), sample).withColumn("node", F.monotonically_increasing_id()))
    owners = nodes.select("node", *(F.col(f"m.{k}").alias(f"_{k}") for k in KEY))
    same = (F.col(KEY[0]) == F.col(f"_{KEY[0]}")) & (F.col(KEY[1]) == F.col(f"_{KEY[1]}")) & (F.col(KEY[2]) == F.col(f"_{KEY[2]}"))

    def candidates(of: DataFrame, schema: str) -> DataFrame:
        keyed = in_arrow(of, _ball_rows, schema).repartition("key").sortWithinPartitions("key", "word")
        return cut(in_arrow(keyed, _candidates, "x long, y long").distinct())

    def both(pairs: DataFrame, *ends: str) -> DataFrame:
        return pairs.select(F.explode(F.array(*ends)).alias("n")).distinct()

    def sets(named: DataFrame) -> DataFrame:
        wanted = small(cut(owners.join(named, F.col("node") == F.col("n"), "left_semi")))
        return _sets(docs.select(*row_key(), "text").join(wanted, same).select("node", "text").dropDuplicates(["node"]))

    met = candidates(nodes.select("node", *prints), "key long, word long, marked long")
    n = met.count()
    few = lambda df: gathered(df, n)
    met = few(met)
    able = cut(few(both(met, "x", "y")))
    linked = tried = met.select(F.col("x").alias("a"), F.col("y").alias("b")).where("false")
    found = linked.select(F.col("a").alias("node"), F.col("b").alias("root"))
    bits = F.lit(0)
    for f in prints:
        bits = bits + F.bit_count(F.col(f"x{f}").bitwiseXOR(F.col(f"y{f}")))
    active = nodes
    for i in range(ROUNDS):
        if i:
            forget(docs.sparkSession)
            roots = active.join(found.select(F.col("node").alias("n"), "root"), F.col("node") == F.col("n"), "left")
            met = few(candidates(few(roots).select("node", *prints, F.coalesce("root", "node").alias("root")), "key long, word long, marked long, root long"))
        side = lambda c, of=active: of.select(F.col("node").alias(c), *(F.col(f).alias(c + f) for f in prints))
        near = cut(few(met.join(side("x"), "x").join(side("y"), "y").select("x", "y", bits.alias("bits")).where(F.col("bits") <= ALL_BITS)))
        if not i:  # the others have nothing near them
            active = cut(few(nodes.select("node", *prints).join(both(near, "x", "y"), F.col("node") == F.col("n"), "left_semi")))
        # a node has a candidate for each of its segments at most
        best = near.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("bits", "y"))), 1, CLOSEST).alias("best")).select("x", F.explode("best.y").alias("y"))
        pairs = cut(few(few(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()).join(tried, ["a", "b"], "left_anti")))
        new = _similar(pairs, sets(both(pairs, "a", "b")))
        if not new.limit(1).count():
            break
        linked, tried = cut(few(linked.union(new))), cut(few(tried.union(pairs)))
        found = cut(few(components(linked)))
    forget(docs.sparkSession)
    roots = few(able.join(found, F.col("n") == F.col("node"), "left").select(F.col("n").alias("node"), F.coalesce("root", "n").alias("root")))
    known = sets(able)
    new = _similar(cut(few(_unjoined(known, roots).join(tried, ["a", "b"], "left_anti"))), known)
    if new.limit(1).count():
        found = cut(few(components(linked.union(new))))
    of = nodes.join(found.select(F.col("node").alias("n"), "root"), F.col("node") == F.col("n"), "left").select("t1", "t2", "node", F.coalesce("root", "node").alias("root"))
    return cut(rows.join(of, ["t1", "t2"]).select(*KEY, "doc_id", "node", "root"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs``, with all its columns, with one row of each group of :func:`similar_groups`: that of least doc_id.

    Null and blank texts are near duplicates of each other. A row without id stays only if its group has no row with one;
    of several the one with the least key. Rows that repeat with their doc_id and text go or stay together. Empty
    documents give no rows.
    """
    found = similar_groups(docs)
    place = F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("d"), *KEY)
    best = found.groupBy(F.col("root").alias("_root")).agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = small(cut(best.select("_root", *(F.col(f"best.{k}").alias(f"_{k}") for k in KEY))))
    differ = (F.col(KEY[0]) != F.col(f"_{KEY[0]}")) | (F.col(KEY[1]) != F.col(f"_{KEY[1]}")) | (F.col(KEY[2]) != F.col(f"_{KEY[2]}"))
    later = found.join(best, F.col("root") == F.col("_root")).where(differ)
    return without(docs, cut(later.select(*KEY).distinct()))
