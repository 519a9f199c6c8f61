"""Self-join of documents by Jaccard similarity of word shingles, with token-combination prefixes.

Shingles are ordered by rarity (document frequency, then hash). Two sets can only be
similar if their prefixes in that order meet: alone for rare shingles, in pairs for
frequent ones, for which the prefix is extended until it still has to share a pair.

1. One read hashes every text into its shingle set. Equal sets are one from here on.
2. A second read sends the sets' shingles, packed by hash bucket, to be counted. Only
   shingles of two or more sets come back to the batch of texts they are from: what no
   other set has can't be shared, and keeps its place in the order by number alone.
3. Each set's prefix yields its signatures. Most sets have none left.
4. Sets that share a signature are compared: first each with the nearest of the leaders of
   its signatures' lists, then twice with the nearest of other ones where lists are still
   in several components, at last all that are not in a list's largest component with
   those of other components. Members of one component are not compared again, so a group
   of n copies costs about n comparisons, and no link between different components goes
   unseen. The last comparison is between sets that are mostly unlike; a wide sketch of each bounds from
   below by how many shingles two sets differ, and leaves few but those that are similar. Members of a large
   group, who share hundreds of long lists, meet in tiles there: once instead of in every list.

Null and empty texts have no shingles and no links. Repeated rows are members of the same
group. The table must give the same rows in the same order when a task is run again, as
stored tables do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hashing import U, as_bytes, constants, mix, shingle_sets
from plumbline.llm.tables import for_workers, settle

#: Shingles of more sets than this are indexed in pairs.
RARE = 64
#: Shingles and texts that one batch holds, and text bytes that one bucket stands for.
BATCH_TOKENS, BATCH_TEXTS, BUCKET_BYTES = 1 << 19, 1 << 14, 8 << 20
#: Most shingles that are broadcast as very frequent; which ones does not change results.
MOST_HOT = 1 << 18
_C = constants(4, 77)
_HOT_RANK = 1 << 31


def _key(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([tokens.sum(dtype=U), mix(tokens ^ _C[0]).sum(dtype=U)], U).tobytes()


def _packed(values: np.ndarray) -> bytes:
    """48-bit integers, their highest bytes first: sorted ones compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 5::-1].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes[::-1].T
    return out.view("<u8").ravel()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes | None, np.ndarray]]:
    for batch in batches:
        for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), shingle_sets(as_bytes(batch.column("text"))), strict=True):
            yield doc_id, _key(tokens) if len(tokens) else None, tokens


def _batches(sets: Iterator[tuple]) -> Iterator[tuple[list, dict[bytes, np.ndarray]]]:
    """Bounded runs of texts: (id, key, size) of each, and the distinct sets."""
    rows, distinct, held = [], {}, 0
    for doc_id, key, tokens in sets:
        rows.append((doc_id, key, len(tokens)))
        if key is not None and key not in distinct:
            distinct[key] = tokens
            held += len(tokens)
        if held >= BATCH_TOKENS or len(rows) >= BATCH_TEXTS:
            yield rows, distinct
            rows, distinct, held = [], {}, 0
    if rows:
        yield rows, distinct


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, key and size of each text's set; and shingles of a hundredth of a batch's sets."""
    for rows, distinct in _batches(_sets(batches)):
        ids = [r[0] for r in rows]
        tokens, count = np.unique(np.concatenate([*distinct.values(), np.zeros(0, U)]), return_counts=True)
        often = count >= max(64, len(distinct) // 100)
        n, m = len(ids), int(often.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids + [None] * m, pa.int64()),
                pa.array([r[1] for r in rows] + [None] * m, pa.binary()),
                pa.array([r[2] for r in rows] + [None] * m, pa.int64()),
                pa.array([None] * n + tokens[often].view(np.int64).tolist(), pa.int64()),
                pa.array([None] * n + count[often].tolist(), pa.int64()),
            ],
            names=["doc_id", "key", "n", "token", "sets"],
        )


_DESCRIBED = "doc_id long, key binary, n long, token long, sets long"
_SENT = "bucket long, batch long, kind int, tokens binary, refs binary, df binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)],
        names=["bucket", "batch", "kind", "tokens", "refs", "df"],
    )


def _send(n_buckets: int, hot: np.ndarray):
    """Shingles of a batch by bucket (kind 0); its sets' keys and sizes (kind 1) and very
    frequent shingles with their rank (kind 2) go past the buckets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (_, distinct) in enumerate(_batches(_sets(batches))):
            if not distinct:
                continue
            batch = (part << 24) + seq
            sizes = np.array([len(t) for t in distinct.values()], np.uint32)
            tokens = np.concatenate(list(distinct.values()))
            refs = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            out = [(-1 - batch, batch, 1, b"".join(distinct), sizes.tobytes(), None)]
            if len(hot):
                at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                is_hot = hot[at] == tokens
                rank = (at[is_hot] + _HOT_RANK).astype(np.uint32)
                out.append((-1 - batch, batch, 2, tokens[is_hot].tobytes(), refs[is_hot].tobytes(), rank.tobytes()))
                tokens, refs = tokens[~is_hot], refs[~is_hot]
            bucket = (tokens % U(n_buckets)).astype(np.int64)
            # by bucket, in it nearly by token, for what is packed to compress
            bits = n_buckets.bit_length()
            order = np.argsort(bucket.astype(U) << U(64 - bits) | tokens >> U(bits))
            tokens, refs, bucket = tokens[order] >> U(16), refs[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                out.append((int(bucket[a]), batch, 0, _packed(tokens[a:b]), refs[a:b].tobytes(), None))
            yield _sent(out)

    return send


def _count(table: pa.Table) -> pa.Table:
    """Keep a bucket's shingles that two or more sets have, with their frequency."""
    rows = table.to_pylist()
    if rows[0]["bucket"] < 0:
        return table
    bucket = rows[0]["bucket"]
    parts = [_unpacked(r["tokens"]) for r in rows]
    tokens, ends = np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])
    _, at, count = np.unique(tokens, return_inverse=True, return_counts=True)
    df = count[at].astype(np.uint32)
    out = []
    for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True):
        keep = df[a:b] > 1
        if keep.any():
            whole = (tokens[a:b][keep] << U(16)) | U(bucket & 0xFFFF)
            refs = np.frombuffer(r["refs"], np.uint16)[keep]
            out.append((bucket, r["batch"], 0, whole.tobytes(), refs.tobytes(), df[a:b][keep].tobytes()))
    return pa.Table.from_batches([_sent(out)]) if out else table.slice(0, 0)


def _signatures(n: int, tokens: np.ndarray, df: np.ndarray) -> list[tuple[int, int, int]]:
    """(signature, place of its first shingle, how many shared ones may come before) of a
    set of ``n``, whose shingles of two or more sets are given in order of rarity.

    A set shares at least ceil(3n/4) shingles with any that is similar, so a prefix in
    which more than n - ceil(3n/4) could not be missed must share something. Frequent
    shingles are dealt over slots by hash; a slot with m of them in the prefix shares a
    pair, or at most one of them, so it counts m - 1. The number of slots follows the
    size class of a set; as partners are of neighbouring classes, each set signs for its
    own and the next one.
    """
    need = n - (3 * n + 3) // 4 + 1 - (n - len(tokens))
    if need <= 0 or n < 2:
        return []
    alone = n - len(tokens)
    rare = df <= RARE
    n_rare = int(rare.sum())
    size_class = math.floor(math.log(n) / math.log(4 / 3) + 1e-9)
    out, last_rare = [], 0
    for scheme in (size_class, size_class + 1):
        slots = max(1, int((4 / 3) ** scheme / 16))
        slot = (tokens[n_rare:] % U(slots)).astype(np.int64)
        gain = np.ones(len(tokens), np.int64)
        gain[n_rare + np.unique(slot, return_index=True)[1]] = 0
        end = min(len(tokens), int(np.searchsorted(np.cumsum(gain), need)) + 1)
        last_rare = max(last_rare, min(end, n_rare))
        if end > n_rare:
            inside = slot[: end - n_rare]
            order = np.argsort(inside, kind="stable")
            cuts = np.flatnonzero(np.diff(inside[order], prepend=-1))
            for group in np.split(order, cuts[1:]):
                if len(group) > 1:
                    a, b = np.triu_indices(len(group), 1)
                    first, second = n_rare + group[a], n_rare + group[b]
                    sign = mix(tokens[first] * _C[1] + tokens[second] * _C[2] + U(scheme + 1))
                    out += [(s, alone + int(p), min(slots, int(p))) for s, p in zip(sign.view(np.int64).tolist(), first, strict=True)]
    sign = mix(tokens[:last_rare] ^ _C[3]).view(np.int64).tolist()
    return out + [(s, alone + i, 0) for i, s in enumerate(sign)]


def _sketch(tokens: np.ndarray) -> list[int]:
    """How many shingles fall in each of 32 slots, modulo 16, four bits a slot."""
    count = (np.bincount(((tokens >> U(20)) % U(32)).astype(np.int64), minlength=32) & 15).astype(np.uint8)
    return (count[::2] << 4 | count[1::2]).view(np.int64).tolist()


#: Words of a wide sketch: 32 counts of two bits each.
WIDE = 8


def _wide_sketch(tokens: np.ndarray) -> list[int]:
    """How many shingles fall in each of 32 * WIDE slots, modulo 4, in Gray code: of two counts, as
    many bits differ as they are apart, the shorter way round."""
    count = (np.bincount(((tokens >> U(28)) % U(32 * WIDE)).astype(np.int64), minlength=32 * WIDE) & 3).astype(np.uint8)
    gray = count ^ (count >> 1)
    return (gray[::4] | gray[1::4] << 2 | gray[2::4] << 4 | gray[3::4] << 6).view(np.int64).tolist()


def _sign(table: pa.Table) -> pa.Table:
    """Of a batch: the sets with signatures."""
    kinds = {0: [], 1: [], 2: []}
    for r in table.to_pylist():
        kinds[r["kind"]].append(r)
    out = {"key": [], "n": [], "m": [], "low": [], "high": [], "wide": [], "tokens": [], "signs": []}
    if kinds[0] or kinds[2]:
        found = kinds[0] + kinds[2]
        keys = kinds[1][0]["tokens"]
        sizes = np.frombuffer(kinds[1][0]["refs"], np.uint32)
        tokens = np.concatenate([np.frombuffer(r["tokens"], U) for r in found])
        refs = np.concatenate([np.frombuffer(r["refs"], np.uint16) for r in found])
        df = np.concatenate([np.frombuffer(r["df"], np.uint32) for r in found])
        order = np.lexsort((tokens, df, refs))
        tokens, refs, df = tokens[order], refs[order], df[order]
        cuts = np.flatnonzero(np.diff(refs.astype(np.int64), prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(refs)], strict=True):
            ref = int(refs[a])
            if signs := _signatures(int(sizes[ref]), tokens[a:b], df[a:b]):
                out["key"].append(keys[16 * ref : 16 * ref + 16])
                out["n"].append(int(sizes[ref]))
                low, high = _sketch(tokens[a:b])
                out["m"].append(int(b - a))
                out["low"].append(low)
                out["high"].append(high)
                out["wide"].append(_wide_sketch(tokens[a:b]))
                out["tokens"].append(_packed(np.sort(tokens[a:b] >> U(16))))
                out["signs"].append([{"sign": s, "place": p, "before": m} for s, p, m in signs])
    sign = pa.struct([("sign", pa.int64()), ("place", pa.int32()), ("before", pa.int32())])
    kinds = [pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.binary(), pa.list_(sign)]
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


_SIGNED = "key binary, n long, m long, low long, high long, wide array<long>, tokens binary, signs array<struct<sign: long, place: int, before: int>>"


def _similar(percent: int):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")), strict=True):
                both = len(np.intersect1d(_unpacked(x), _unpacked(y), assume_unique=True))
                keep.append(100 * both >= percent * (n + m - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return similar


def _verified(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b), those whose sets are similar."""
    left = signed.select(F.col("key").alias("a"), "n", F.col("tokens").alias("x"))
    right = signed.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_similar(75), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """Smallest key (label) reachable from each key over ``links`` (a, b).

    Each round takes the least label among neighbours, then that label's own label, so
    chains shorten by more than a step a round. Rounds end when nothing changes."""
    both = links.union(links.select("b", "a")).toDF("key", "other").filter("key != other").distinct()
    both = settle(both)
    labels = settle(both.groupBy("key").agg(F.min("other").alias("least")).select("key", F.least("key", "least").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.min("label").alias("near"))
        step = labels.join(near, "key").select("key", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = settle(step)
        jump = step.select(F.col("key").alias("label"), F.col("label").alias("further"))
        labels = settle(step.join(jump, "label", "left").select("key", "was", F.least("label", "further").alias("label")))
        if labels.filter("label != was").isEmpty():
            return labels.select("key", "label")
        labels = labels.select("key", "label")


#: What a list says of a member.
_MEMBER = ["key", "n", "m", "low", "high", "place", "before"]


def _slots_apart(x: Column, y: Column) -> Column:
    """Sum over 16 slots of the difference of two counts modulo 16, the shorter way round.
    Every other slot is taken at once, each in a byte of its own; as 256 is 1 modulo 255,
    the remainder is the sum of the bytes, which is at most 128."""
    low, one = 0x0F0F0F0F0F0F0F0F, 0x0101010101010101
    total = None
    for shift in (0, 4):
        u, v = (F.shiftrightunsigned(c, shift).bitwiseAND(low) for c in (x, y))
        d = (u.bitwiseOR(16 * one) - v).bitwiseAND(low)
        far = F.shiftright(d, 3).bitwiseAND(one)  # 8 or more: 16 - d is the bits' complement and one
        way = d.bitwiseXOR(far * 15) + far
        total = way if total is None else total + way
    return total % 255


def _apart(a: str, b: str) -> Column:
    """Least number of shingles that only one of two sets has: those no other set has, and
    of the rest, by how much the counts of their slots differ."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    return x("n") - x("m") + y("n") - y("m") + _slots_apart(x("low"), y("low")) + _slots_apart(x("high"), y("high"))


def _fits(a: str, b: str) -> Column:
    """Sizes, places and counts allow a similarity of 0.75. Shared are at most what is from the
    first common shingle on and may come before it; a seventh of both sets' sizes may differ."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    most = F.least(x("n") - x("place"), y("n") - y("place")) + F.least(x("before"), y("before"))
    sizes = 100 * F.least(x("n"), y("n")) >= 75 * F.greatest(x("n"), y("n"))
    return sizes & (700 * most >= 300 * (x("n") + y("n"))) & (7 * _apart(a, b) <= x("n") + y("n"))


def _wide_apart(a: str, b: str) -> Column:
    """As ``_apart``, by the wide sketches."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    total = x("n") - x("m") + y("n") - y("m")
    for k in range(WIDE):
        total = total + F.bit_count(x(f"w{k}").bitwiseXOR(y(f"w{k}")))
    return total


#: Few sets and others of one tile at most (about), and bytes of their shingles.
TILE_FEW, TILE_OTHERS, TILE_BYTES = 1 << 10, 1 << 12, 24 << 20
#: A comparison within a tile costs so much less than one of two rows of a list.
CHEAPER = 16


def _compared(table: pa.Table) -> pa.Table:
    """Of a tile: similar pairs of a set of side 0 and one of side 1 in another component, one for
    each set and component. The wide sketches leave few pairs whose shared shingles are counted."""
    side, n, m = (table.column(c).to_numpy() for c in ("side", "n", "m"))
    keys, label = table.column("key").to_pylist(), table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    wide = table.column("wide").combine_chunks().flatten().to_numpy().view(U).reshape(-1, WIDE)
    parts = [_unpacked(t) for t in table.column("tokens").to_pylist()]
    ends = np.cumsum([len(p) for p in parts])
    distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
    sets = np.split(at, ends[:-1])
    mark = np.zeros(len(distinct), bool)
    others, out = np.flatnonzero(side == 1), []
    o_wide, o_n, o_alone, o_label = wide[others], n[others], (n - m)[others], label[others]
    for i in np.flatnonzero(side == 0):
        apart = np.bitwise_count(o_wide ^ wide[i]).sum(axis=1, dtype=np.int64) + o_alone + (n[i] - m[i])
        met = np.flatnonzero((7 * apart <= o_n + n[i]) & (o_label != label[i]))
        if not len(met):
            continue
        found = [sets[j] for j in others[met]]
        mark[sets[i]] = True
        both = np.add.reduceat(mark[np.concatenate(found)], np.cumsum([0] + [len(f) for f in found[:-1]]), dtype=np.int64)
        mark[sets[i]] = False
        met = met[100 * both >= 75 * (n[i] + o_n[met] - both)]
        first = np.unique(o_label[met], return_index=True)[1]
        out += [(keys[i], keys[j]) for j in others[met[first]]]
    return pa.table([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _gathered(met: DataFrame, few: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``few`` that are to be compared list by list, and similar pairs of the other ones.

    What members of a large group share is in hundreds of long lists, so that list by list they would
    meet as often. The few sets whose longest list is the same are a group; it is compared once with all
    that meet one of it in any long list, in tiles, if that takes fewer comparisons."""
    long_few = settle(few.filter(F.col("many") > RARE).select("key", "sign", "many"))
    if long_few.isEmpty():
        return few, None
    home = long_few.groupBy("key").agg(F.max(F.struct("many", "sign")).alias("top")).select("key", F.col("top.sign").alias("home"))
    asked = settle(long_few.join(home, "key").groupBy("home", "sign").agg(F.count("*").alias("few"), F.first("many").alias("many")))
    facts = met.join(asked.select("home", "sign"), "sign").select("home", "key", "label").distinct()
    sizes = signed.select("key", "m")
    others = settle(facts.join(sizes, "key"))
    those = settle(home.join(sizes, "key"))
    count = F.count("*"), F.sum(F.col("m") * 6)
    x = those.groupBy("home").agg(count[0].alias("x"), count[1].alias("x_bytes"))
    y = others.groupBy("home").agg(count[0].alias("y"), count[1].alias("y_bytes"))
    listed = asked.groupBy("home").agg(F.sum(F.col("few") * F.col("many")).alias("listed"))
    plan = x.join(y, "home").join(listed, "home").filter(F.col("x") * F.col("y") <= CHEAPER * F.col("listed"))
    tiles = [
        F.greatest(F.ceil(F.col(c) / most), F.ceil(F.col(f"{c}_bytes") / TILE_BYTES)).cast("int").alias(f"n_{c}")
        for c, most in (("x", TILE_FEW), ("y", TILE_OTHERS))
    ]
    plan = settle(plan.select("home", *tiles))
    dealt, all_of = F.xxhash64("key", F.lit(1)), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = those.join(plan, "home").select("home", "key", F.lit(0).alias("side"), F.pmod(dealt, "n_x").cast("int").alias("x"), all_of("n_y").alias("y"))
    own = own.union(others.join(plan, "home").select("home", "key", F.lit(1), all_of("n_x"), F.pmod(dealt, "n_y").cast("int")))
    label = others.select("key", "label").distinct()
    sets = signed.select("key", "n", "m", "wide", "tokens").join(label, "key")
    tiled = own.join(sets, "key")
    links = tiled.groupBy("home", "x", "y").applyInArrow(_compared, "a binary, b binary")
    whole = home.join(plan, "home").select("key", F.lit(True).alias("whole"))
    rest = few.join(whole, "key", "left").filter((F.col("many") <= RARE) | F.col("whole").isNull())
    return rest.select(*few.columns), links


def _remaining(named: DataFrame, signed: DataFrame) -> DataFrame:
    """Links between different components in open lists: all that are not in a list's largest
    component are compared with those of other components."""
    wide = signed.select("key", *(F.col("wide")[k].alias(f"w{k}") for k in range(WIDE)))
    member = F.struct(*_MEMBER, "label", *(f"w{k}" for k in range(WIDE)))
    share = settle(named.groupBy("sign", "label").count())
    main = share.groupBy("sign").agg(F.max(F.struct("count", "label")).alias("main"), F.sum("count").alias("many"))
    main = main.select("sign", "many", F.col("main.label").alias("largest"))
    met = settle(named.join(main, "sign").select("sign", *_MEMBER, "label", "many", (F.col("label") != F.col("largest")).alias("few")))
    few, links = _gathered(met, met.filter("few"), signed)
    few = few.join(wide, "key").select("sign", member.alias("b"))
    lists = met.join(few.select("sign").distinct(), "sign", "left_semi").join(wide, "key").select("sign", member.alias("a"))
    pairs = lists.join(few, "sign").filter(F.col("a.label") != F.col("b.label")).filter(_fits("a", "b"))
    pairs = pairs.filter(7 * _wide_apart("a", "b") <= F.col("a.n") + F.col("b.n"))
    pairs = pairs.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b"))
    found = _verified(pairs.distinct(), signed)
    return found if links is None else found.union(links)


def _links(signed: DataFrame) -> DataFrame:
    """Components of the signed sets: key, label; sets without links may be missing."""
    lists = signed.select(*_MEMBER[:5], F.explode("signs").alias("s")).select(*_MEMBER[:5], "s.sign", "s.place", "s.before")
    several = lists.groupBy("sign").agg(F.count("*").alias("members")).filter("members > 1").select("sign")
    lists = settle(lists.join(several, "sign"))
    labels = None
    for turn, last in enumerate((False, False, False, True)):
        if labels is None:
            named = lists.withColumn("label", F.col("key"))
            head = F.struct(*_MEMBER, "label")
            chosen = named.groupBy("sign").agg(F.min(head).alias("b"))
        else:
            named = lists.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
            named = settle(named)
            open_lists = named.groupBy("sign").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y")
            named = named.join(open_lists.select("sign"), "sign")
            # lists are kept from round to round: another member leads in each
            head = F.struct(F.xxhash64(F.lit(turn), "sign", "key").alias("at"), *_MEMBER, "label")
            chosen = named.groupBy("sign").agg(F.min(head).alias("b"))
        if last:
            new = settle(_remaining(named, signed))
        else:
            left = named.select("sign", F.struct(*_MEMBER, "label").alias("a"))
            pairs = left.join(chosen, "sign").filter(F.col("a.label") != F.col("b.label")).filter(_fits("a", "b"))
            # one a set, so that a group gets about a link a member; the last round misses none
            nearest = F.min(F.struct(_apart("a", "b").alias("apart"), F.col("b.key").alias("key")))
            pairs = pairs.groupBy(F.col("a.key").alias("a")).agg(nearest.alias("b")).select("a", F.col("b.key").alias("b"))
            new = settle(_verified(pairs, signed))
        if labels is None:
            labels = components(new)
        elif not new.isEmpty():
            # what is known is a link of each member to its component's label
            labels = components(new.union(labels.toDF("a", "b")))
    return labels


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links
    of similarity 0.75 or more between sets of five-word shingles, itself included)."""
    spark = docs.sparkSession
    docs = for_workers(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    described = settle(docs.mapInArrow(_describe, _DESCRIBED))
    rows = described.filter("n IS NOT NULL").select("doc_id", "key", "n")
    often = described.filter("token IS NOT NULL").groupBy("token").agg(F.sum("sets").alias("sets"))
    often = often.orderBy(F.desc("sets"), "token").limit(MOST_HOT).toArrow()
    hot = np.sort(often.column("token").to_numpy().view(U))
    # about seven bytes of text to a shingle
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total * 7 // BUCKET_BYTES, 1)
    sent = docs.mapInArrow(_send(n_buckets, hot), _SENT)
    shared = sent.groupBy("bucket").applyInArrow(_count, _SENT)
    signed = settle(shared.groupBy("batch").applyInArrow(_sign, _SIGNED).dropDuplicates(["key"]))
    labels = _links(signed)
    sets = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"))
    sets = sets.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = sets.groupBy("label").agg(F.min("least").alias("component_id"))
    named = sets.select("key", "label").join(least, "label").select("key", "component_id")
    return rows.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
