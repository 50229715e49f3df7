"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the groups that these links make.

A size-aware heavy-light join. Shingles are ordered from rare to common. Two sets that are alike share a shingle within
short prefixes of that order, and a second one within prefixes longer by one. A shingle of few sets is a key by itself.
For those of more than _LIGHT sets, small sets enumerate the subsets of two such shingles of their prefix, and meet by
equal subsets; large sets scan the inverted lists of the single shingles. Where small ends is chosen by cost: subsets
made, each of which is a row that is moved, against list entries scanned.

Steps and what they move:
1. Sets are hashed to classes of equal sets; copies are out of the search from there on. The same pass finds shingles
   that hold an uncommon share of all entries (at most _COMMON of them) and classes of very many copies (as few).
2. Shingles of one set of each class and task are dealt by hash in packed rows, some three million to a bucket; a bucket
   counts sets by shingle and sends back only shingles that two sets or more hold. Common shingles need no count and go
   straight to where a set is put together, so no bucket gets an entry of every set. A shingle of one set can match
   nothing, so the number of them bounds what the set can overlap with: most sets drop out here.
3. Sets left get their keys. Each set is first compared with one pivot, of its keys the set with the fewest shingles of
   its own; links make components. Then, key by key, all sets outside the largest component of a key are compared with
   all sets of the key in other components, if size, position and a parity sketch of what the sets have not in common
   allow. Pairs within a component need no comparison, as no link between them changes it. So no group of near copies
   is expanded into pairs.
4. Every compared pair is verified on its sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import cut, scratch
from sparkseek.llm.components import connected_components
from sparkseek.llm.kernels import Frequent, mix64, shingle_sets, slices

_PER_BUCKET = 3_000_000
_KEYS = 200_000
#: Shingles that are known to be common before sets are counted, and classes known to have very many copies.
_COMMON = 65_536
#: A shingle of at most so many sets is a key by itself.
_LIGHT = 64
#: What a subset costs, which becomes a row, in entries of an inverted list, which are only looked at.
_ROW = 32
_MARK = np.uint64(1 << 63)
#: Parity sketch of a set's shared shingles, 256 bits: whether an odd number of them falls on each bit. Bits in which two
#: sets differ are no more than the shared shingles that one has and the other has not.
PARITY = ["p0", "p1", "p2", "p3"]


def _signature(shingles: np.ndarray) -> tuple[int, int]:
    mixed = mix64(shingles ^ np.uint64(0x6A09E667F3BCC909))
    total = np.array([mixed.sum(dtype=np.uint64), mix64(mixed).sum(dtype=np.uint64)])
    return tuple(int(x) for x in mix64(total + np.uint64(len(shingles))).view(np.int64))


def _lists(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def least_overlap(size, num: int, den: int):
    """The fewest shingles that a set of this size shares with any set that it is alike."""
    return -(-num * size // den)


def document_sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, s1, s2, seen): size and 128-bit signature of every row's set, seen being null; and for shingles that
    sixteen sets or more of a task hold, s1 the shingle and seen how many do."""

    def describe(batches):
        frequent, known = Frequent(_COMMON), set()
        names = ["id", "n", "s1", "s2", "seen"]
        kind = None
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column("text"), width))
                rows = [(len(s), *_signature(s)) for s in sets]
                new = [s for s, row in zip(sets, rows, strict=True) if len(s) and row[1] not in known and not known.add(row[1])]
                if new:
                    frequent.add(np.concatenate(new))
                n, s1, s2 = zip(*rows, strict=True) if rows else ((), (), ())
                kind = part.column("id").type
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.nulls(len(n), pa.int64())], names=names)
        keys, counts = frequent.at_least(16)
        if len(keys):
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), kind), none, pa.array(keys.view(np.int64)), none, pa.array(counts)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(describe, f"id {kind}, n long, s1 long, s2 long, seen long")


def shared_shingles(texts: DataFrame, width: int, num: int, den: int, buckets: int, common: dict | None = None, keepers: dict | None = None) -> DataFrame:
    """From texts(id, text), the sets that may be alike another: (sig, n, own, light, shared, subsets, scans, PARITY).

    own: shingles that no other set holds. shared: the others, from rare to common, packed; light of those in the prefix
    are of few sets. subsets, scans: the cost of the rest of the prefix for a small set and for a large one. common:
    shingles with their place in the order, which are not counted. keepers: for classes of very many copies the one id
    whose set is taken. Both must be small. Shingles go by 40 bits within a bucket."""
    fewest = math.floor(num / (den - num)) + (num % (den - num) > 0) if den > num else 1 << 62
    common, keepers = common or {}, keepers or {}
    known = np.array(sorted(common), np.uint64)
    context = texts.sparkSession.sparkContext
    told = context.broadcast((known, np.array([min(common[int(k)], 2**31 - 1) for k in known], np.int32), keepers))

    def deal(batches):
        known, _, keepers = told.value
        seen = set()
        for batch in batches:
            for part in slices(batch):
                sets, sigs = [], []
                for at, s in enumerate(shingle_sets(part.column("text"), width)):
                    if len(s) >= fewest and (sig := _signature(s)) not in seen:  # copies in this task go once
                        seen.add(sig)
                        if sig[0] in keepers and keepers[sig[0]] != part.column("id")[at].as_py():
                            seen.discard(sig)
                            continue
                        sets.append(s)
                        sigs.append(sig[0])
                if not sets:
                    continue
                sizes = np.array([len(s) for s in sets])
                every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                sigs = np.array(sigs, np.int64)
                out = {c: [] for c in packed.names}
                # The sets themselves and their common shingles, to where they are put together.
                spot = np.minimum(np.searchsorted(known, every), max(len(known) - 1, 0))
                often = known[spot] == every if len(known) else np.zeros(len(every), bool)
                n_often = np.bincount(of[often], minlength=len(sets))
                ends = np.cumsum(n_often)
                places, place = spot[often].astype(np.int32), (mix64(sigs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(place).tolist():
                    mine = np.flatnonzero(place == b)
                    out["bucket"].append(-1 - b)
                    out["sigs"].append(sigs[mine].tobytes())
                    out["lengths"].append(np.stack([sizes[mine], n_often[mine]]).astype(np.int32).T.tobytes())
                    out["shingles"].append(b"".join(places[ends[k] - n_often[k] : ends[k]].tobytes() for k in mine.tolist()))
                every, of = every[~often], of[~often]
                if len(every):
                    bucket = (mix64(every) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket * len(sets) + of, kind="stable")
                    every, of, bucket = every[order], of[order], bucket[order]
                    new = np.append(True, (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1]))
                    first = np.flatnonzero(new)
                    new |= (np.arange(len(every)) - np.repeat(first, np.diff(np.append(first, len(every))))) % 255 == 0  # a length is a byte
                    run = np.flatnonzero(new)
                    length = np.diff(np.append(run, len(every))).astype(np.uint8)
                    edge = np.flatnonzero(np.append(True, bucket[run][1:] != bucket[run][:-1]))
                    owner, short = sigs[of[run]], every.view(np.uint8).reshape(-1, 8)[:, :5]
                    for a, b in zip(edge.tolist(), np.append(edge[1:], len(run)).tolist(), strict=True):
                        out["bucket"].append(int(bucket[run[a]]))
                        out["sigs"].append(owner[a:b].tobytes())
                        out["lengths"].append(length[a:b].tobytes())
                        out["shingles"].append(short[run[a] : run[b] if b < len(run) else len(every)].tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=packed)

    packed = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("sigs", "lengths", "shingles"))])
    sent_back = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("sigs", "lengths", "counts", "shingles"))])

    def count(table: pa.Table) -> pa.Table:
        number = table.column("bucket")[0].as_py()
        if number < 0:
            rows = len(table)
            return pa.Table.from_arrays([pa.array([-1 - number] * rows, pa.int32()), table.column("sigs"), table.column("lengths"), pa.array([b""] * rows, pa.binary()), table.column("shingles")], schema=sent_back)
        length = _lists(table.column("lengths"), np.uint8)
        sigs = np.repeat(_lists(table.column("sigs"), np.int64), length)
        shingles = np.zeros((len(sigs), 8), np.uint8)
        shingles[:, :5] = _lists(table.column("shingles"), np.uint8).reshape(-1, 5)
        shingles = shingles.view(np.uint64).ravel()
        order = np.argsort(shingles, kind="stable")
        key = shingles[order]
        n = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
        order = order[np.repeat(n > 1, n)]  # held twice, but maybe by copies in two tasks
        key, owner = shingles[order], sigs[order]
        again = np.lexsort((owner, key))
        key, owner = key[again], owner[again]
        distinct = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])) if len(key) else np.zeros(0, bool)
        key, owner = key[distinct], owner[distinct]
        n = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))) if len(key) else np.zeros(0, np.int64)
        n = np.repeat(n, n)
        key, owner, n = key[n > 1] | np.uint64(number << 40), owner[n > 1], n[n > 1]
        part = (mix64(owner.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((owner, part))
        key, owner, n, part = key[order], owner[order], n[order], part[order]
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        out = {c: [] for c in sent_back.names}
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(part)).tolist(), strict=True) if len(part) else ():
            out["part"].append(int(part[a]))
            out["lengths"].append(b"")
            for name, values in (("sigs", owner), ("counts", np.minimum(n, 2**31 - 1).astype(np.int32)), ("shingles", key)):
                out[name].append(values[a:b].tobytes())
        return pa.Table.from_pydict(out, schema=sent_back)

    found = pa.schema([("sig", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("light", pa.int64()), ("shared", pa.binary()), ("subsets", pa.int64()), ("scans", pa.int64()), *((p, pa.int64()) for p in PARITY)])

    def gather(table: pa.Table) -> pa.Table:
        _, often, _ = told.value
        whole = pc.greater(pc.binary_length(table.column("lengths")), 0)
        sets, counted = table.filter(whole), table.filter(pc.invert(whole))
        set_sigs, first = np.unique(_lists(sets.column("sigs"), np.int64), return_index=True)
        size, n_often = _lists(sets.column("lengths"), np.int32).reshape(-1, 2).T
        begin = np.cumsum(n_often) - n_often
        size, n_often, begin = size[first], n_often[first], begin[first]  # of copies from several tasks, one
        at = np.repeat(begin, n_often) + np.arange(n_often.sum()) - np.repeat(np.cumsum(n_often) - n_often, n_often)
        places = _lists(sets.column("shingles"), np.int32)[at]
        sigs = np.concatenate([_lists(counted.column("sigs"), np.int64), np.repeat(set_sigs, n_often)])
        counts = np.concatenate([_lists(counted.column("counts"), np.int32), often[places]])
        shingles = np.concatenate([_lists(counted.column("shingles"), np.uint64), places.astype(np.uint64) | _MARK])
        order = np.lexsort((shingles, counts, sigs))
        sigs, counts, shingles = sigs[order], counts[order], shingles[order]
        sizes = size[np.searchsorted(set_sigs, sigs)]
        edge = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1])) if len(sigs) else np.zeros(0, np.int64)
        out = {c: [] for c in found.names}
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(sigs)).tolist(), strict=True) if len(sigs) else ():
            n = int(sizes[a])
            if b - a < least_overlap(n, num, den):
                continue
            own = n - (b - a)
            prefix = n - least_overlap(n, num, den) + 1 - own
            light = int((counts[a : a + prefix] <= _LIGHT).sum())
            heavy = prefix - light
            odd = (np.bincount((mix64(shingles[a:b]) >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8)
            parity = np.packbits(odd).view(np.int64).tolist()
            for name, value in zip(found.names, (int(sigs[a]), n, own, light, shingles[a:b].tobytes(), (heavy + 1) * heavy // 2, int(counts[a + light : a + prefix].sum()), *parity), strict=True):
                out[name].append(value)
        return pa.Table.from_pydict(out, schema=found)

    ddl = lambda schema: ", ".join(f"{f.name} {dict(int32='int', int64='long', binary='binary')[str(f.type)]}" for f in schema)
    dealt = texts.select("id", "text").mapInArrow(deal, ddl(packed))
    counted = dealt.groupBy("bucket").applyInArrow(count, ddl(sent_back))
    return counted.groupBy("part").applyInArrow(gather, ddl(found))


def cheapest_boundary(sets: DataFrame) -> int:
    """The largest size of a small set: the power of two that makes the fewest subsets and list entries together."""
    rows = sets.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.sum("subsets"), F.sum("scans")).collect()  # 64 rows at most
    cost = {k: (_ROW * subsets, scans) for k, subsets, scans in rows}
    return min((sum(c[0] if k < end else c[1] for k, c in cost.items()), 1 << end) for end in range(max(cost, default=0) + 2))[1] - 1


def prefix_keys(sets: DataFrame, num: int, den: int, boundary: int) -> DataFrame:
    """(key, sig, node, n, own, PARITY, reach) from sets(sig, node, n, own, light, shared, PARITY): the light shingles of
    the prefix; of the others, subsets of two in small sets, and single ones in large sets and in small ones that a large
    one may be alike. reach: the most that the set can share if the key begins with the first shingle that it shares."""
    names = ["key", "sig", "node", "n", "own", *PARITY, "reach"]

    def make(batches):
        for batch in batches:
            keys, which, reach, held = [], [], [], 0

            def made(batch, keys, which, reach):
                whole = batch.select(names[1:-1]).take(pa.array(np.concatenate(which)))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(whole.column(c) for c in names[1:-1]), pa.array(np.concatenate(reach).astype(np.int64))], names=names)

            shingles = batch.column("shared")
            for row, (n, own, light) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "own", "light")), strict=True)):
                shared = np.frombuffer(shingles[row].as_buffer(), np.uint64)
                prefix = n - least_overlap(n, num, den) + 1 - own
                one = prefix if n > boundary or den * n > num * boundary else light
                keys.append(mix64(shared[:one]))
                reach.append(n - own - np.arange(one))
                if n <= boundary and light < prefix:
                    two = shared[light : prefix + 1]
                    a, b = np.triu_indices(len(two), 1)
                    keys.append(mix64(mix64(two[a]) + two[b] * np.uint64(0xBB67AE8584CAA73B)))
                    reach.append(n - own - light - a)
                which.append(np.full(sum(len(k) for k in keys) - sum(len(w) for w in which), row))
                held += len(which[-1])
                if held > _KEYS:
                    yield made(batch, keys, which, reach)
                    keys, which, reach, held = [], [], [], 0
            if keys:
                yield made(batch, keys, which, reach)

    kind = sets.schema["node"].dataType.simpleString()
    return sets.select("sig", "node", "n", "own", *PARITY, "light", "shared").mapInArrow(make, f"key long, sig long, node {kind}, n long, own long, {', '.join(f'{p} long' for p in PARITY)}, reach long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs(x, y) of sigs those whose sets are alike, as (a, b) of nodes."""
    side = lambda s, k: sets.select(F.col("sig").alias(s), F.col("node").alias(f"node{k}"), F.col("n").alias(f"n{k}"), F.col("shared").alias(f"shared{k}"))

    def alike(batches):
        for batch in batches:
            keep, x, y = [], batch.column("shared1"), batch.column("shared2")
            for row, (n, m) in enumerate(zip(batch.column("n1").to_pylist(), batch.column("n2").to_pylist(), strict=True)):
                a, b = (np.frombuffer(c[row].as_buffer(), np.uint64) for c in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * both >= num * (n + m - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node1").filter(keep), batch.column("node2").filter(keep)], names=["a", "b"])

    kind = sets.schema["node"].dataType.simpleString()
    return pairs.join(side("x", 1), "x").join(side("y", 2), "y").select("node1", "n1", "shared1", "node2", "n2", "shared2").mapInArrow(alike, f"a {kind}, b {kind}")


def jaccard_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs (id_col, n_shingles, component_id): its set's size and the smallest id that it reaches by
    links, its own included. Two rows link when their Jaccard similarity is num/den or more.

    Words are split at blanks and A-Z are lower-cased. A row of fewer than width words has its whole sequence as one
    shingle; a null, empty or blank text has none and links with nothing. Rows with the same id are one document: they
    reach each other. A row without an id is in no link and has a null component_id. An empty table gives an empty
    result. Shingles are compared by 64-bit hashes, classes of equal sets by 128 bits; in the search a class goes by 64
    bits, of which two of 10**10 classes may share one."""
    if not 0 < num <= den:
        raise ValueError("num / den must be above 0 and at most 1")
    with scratch(docs.sparkSession) as keep:
        return keep(_groups(docs, width, num, den, id_col, text_col))


def _groups(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    described = cut(document_sets(docs, width, id_col, text_col))
    info = described.where("seen IS NULL").drop("seen")
    counted = info.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = cut(counted.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies")))
    total, rows = classes.agg(F.sum("n"), F.sum("copies")).first()
    buckets = max(64, -(-(total or 0) // _PER_BUCKET))
    # Both are few by what they are a share of, and at most _COMMON numbers.
    often = described.where("seen IS NOT NULL").groupBy("s1").agg(F.sum("seen").alias("seen")).where(F.col("seen") > (total or 0) // buckets // 8)
    common = {k & (2**64 - 1): seen for k, seen in often.orderBy(F.desc("seen"), "s1").limit(_COMMON).collect()}
    copied = classes.where(F.col("copies") > max(1000, (rows or 0) // _COMMON)).select("s1", "rep").limit(_COMMON)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = shared_shingles(texts, width, num, den, buckets, common, dict(map(tuple, copied.collect())))
    sets = cut(found.join(classes.select(F.col("s1").alias("sig"), F.col("rep").alias("node")), "sig"))
    keys = cut(prefix_keys(sets, num, den, cheapest_boundary(sets)))

    # Each set against one pivot.
    pivots = cut(
        keys.groupBy("key")
        .agg(F.count("*").alias("members"), F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "sig")).alias("pivot"))
        .where("members > 1").select("key", "pivot")
    )
    stars = cut(
        keys.join(pivots, "key").where(F.col("sig") != F.col("pivot.sig"))
        .groupBy("sig").agg(F.min("pivot").alias("pivot"))
        .select(F.col("sig").alias("x"), F.col("pivot.sig").alias("y"))
    )
    same_id = counted.select("id", "s1", "s2").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).where(F.col("id") != F.col("rep"))
    repeated_ids = counted.groupBy("id").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).where(F.col("a") != F.col("b")).select("id")
    tied = same_id.join(repeated_ids, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    groups = connected_components(cut(verified(stars, sets, num, den).union(tied)))

    # Key by key, what is outside the largest component against all other components.
    member = cut(
        keys.join(pivots.select("key"), "key", "left_semi")
        .join(groups.withColumnRenamed("component", "c"), "node", "left")
        .select("key", "sig", "n", "own", "reach", *PARITY, F.coalesce("c", "node").alias("c"))
    )
    largest = cut(
        member.groupBy("key", "c").agg(F.count("*").alias("k"))
        .groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("k", "c"))["c"].alias("major"))
        .where("kinds > 1").select("key", "major")
    )
    # Sizes that one set may be alike are in at most three classes.
    ratio = math.log(max(den / num, 1.05))
    band = lambda size: F.floor(F.log(size.cast("double")) / ratio).cast("int")
    low = F.ceil(F.col("n") * num / den)
    high = F.floor(F.least(F.col("n") * den / num, F.col("reach") * (num + den) / num - F.col("n")) + 1e-9)
    mixed = cut(member.join(largest, "key").where(high >= low).withColumn("band", band(F.col("n"))))
    minor = cut(
        mixed.where(F.col("c") != F.col("major"))
        .withColumn("band", F.explode(F.sequence(band(low), band(high))))
        .select("key", "band", F.col("sig").alias("x"), F.col("n").alias("n1"), F.col("own").alias("own1"), F.col("reach").alias("reach1"), F.col("c").alias("c1"), *[F.col(p).alias(f"{p}_1") for p in PARITY])
    )
    most = F.least("reach", "reach1")
    apart = F.col("own") + F.col("own1") + sum(F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}_1"))) for p in PARITY)  # at least so many are in one set only
    others = cut(
        minor.join(mixed, ["key", "band"])
        .where((F.col("c") != F.col("c1")) & (F.lit(num + den) * most >= F.lit(num) * (F.col("n") + F.col("n1"))) & (F.lit(num + den) * apart <= F.lit(den - num) * (F.col("n") + F.col("n1"))))
        .select(F.least("x", "sig").alias("x"), F.greatest("x", "sig").alias("y")).distinct()
    )
    more = cut(verified(others, sets, num, den))
    if more.limit(1).count():
        groups = connected_components(more.union(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    by_class = cut(classes.join(groups, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id")))
    placed = counted.join(by_class, ["s1", "s2"]).select("id", "n", "component_id")
    rest = info.where(F.col("id").isNull() | (F.col("n") == 0)).select("id", "n", F.col("id").alias("component_id"))
    return placed.union(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
