"""Near duplicates by an exact Jaccard join on word shingles, with adaptive multi-match prefixes.

Equal shingle sets form classes, and everything after that is about classes. Documents link if the similarity of
their sets is at least num / den = t; a set X of n shingles then misses at most e = n - ceil(t n) of its shingles in
any partner. In one order of all shingles, rarest first, linked sets share a shingle among the first e + 1 of each,
and l shingles among the first e + l: the l-prefix. The steps:

1. One pass over the texts writes each set's size, its 64-bit key, and its shingles of a fixed part of the hash range.
   A class with more than e shingles there that no other class has can have no partner. This sieve leaves few classes;
   their whole sets are made again and written.
2. Among these, shingles are counted. Each class gets its l-prefix: l grows while the estimated cost of the candidates
   falls.
3. Each prefix shingle names a hub, the member with the fewest shingles of its own. Members are verified against
   their hubs, which links large groups of near copies by as many pairs as there are members.
4. Members of a prefix shingle that these links do not connect are compared in blocks of bounded size, and of a long
   list only blocks of sizes that can link: sizes, shingles of their own, and parity bitmaps bound the similarity from
   above. Pairs that pass, and share as many prefix shingles as the shorter prefix demands, are verified on the whole sets.
5. Connected components of the links, by alternating stars.

Shingles and keys are 64-bit hashes. Nothing is capped or sampled. Rows are known by their doc_id (or without one by
their text's hash) and their text's hash. Joins whose keys may be hot are spread by _common.spread_join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _common as C

#: The longest l of a prefix, and the cost of verifying a candidate, in steps through a list of prefix members.
MOST_MATCHES, VERIFY_COST = 4, 8
#: Members of one prefix shingle that a task compares with each other at once.
BLOCK = 1024
BITS = 1024
#: Ids broadcast at most (16 bytes each); beyond, joins shuffle.
BROADCAST_ROWS = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's set, ascending: hashes of its distinct k-word shingles, A-Z in lower case.

    With fewer than k words, the hash of the whole sequence; without words, nothing.
    """
    import xxhash

    offsets, codes, distinct = C.words(pc.ascii_lower(text))
    word = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = max(0, len(word) - k + 1)
    spread = np.zeros(n, np.uint64)
    for j in range(k):
        spread = spread * np.uint64(0x9E3779B97F4A7C15) + word[j : j + n]
    spread = _mix(spread)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= k:
            yield np.unique(spread[a : b - k + 1])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for x in word[a:b]:
                short = short * np.uint64(0x9E3779B97F4A7C15) + x
            yield _mix(short + np.uint64(b - a))  # not the hash of any k words
        else:
            yield np.zeros(0, np.uint64)


def _key(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def _missing(n: Column, num: int, den: int) -> Column:
    """e: how many of its n shingles a set can miss in a partner."""
    return n - F.floor((n * num + (den - 1)) / F.lit(den)).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to have few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """What a row is known by: its doc_id, or without one its text's hash, and its text's hash; a null text is empty."""
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return F.coalesce(docs["doc_id"].cast("long"), text), text


def _tables(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Step 1: (doc_id, jid, th, n, key) of every row, and (key, n, set, bits) of the classes that can have a partner."""
    C.settings(docs.sparkSession)
    text = C.documents(docs, "doc_id", "text")
    jid, th = _row_keys(text)
    text = text.select("doc_id", "text", jid.alias("jid"), th.alias("th"))
    share = min(1.0, 2 * (1 - num / den))
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            n, key, parts = [], [], []
            for found in shingle_sets(batch.column("text"), k):
                n.append(len(found))
                key.append(_key(found) if len(found) else None)
                parts.append(found[: np.searchsorted(found, limit)].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int64), *parts]))
            ids = [batch.column(c).cast(pa.int64()) for c in ("doc_id", "jid", "th")]
            yield pa.record_batch([*ids, pa.array(n, pa.int64()), pa.array(key, pa.int64()), tokens], ["doc_id", "jid", "th", "n", "key", "tokens"])

    rows = C.written(text.mapInArrow(first, "doc_id long, jid long, th long, n long, key long, tokens array<long>"), "sets")
    some = rows.filter("n > 0")
    # a shingle is of one class alone if the least and the greatest key are the same; copies are combined on the way
    alone = some.select("key", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    alone = alone.filter("key = last").groupBy("key").agg(F.count("*").alias("alone"))
    classes = some.groupBy("key").agg(F.max("n").alias("n"), F.min("jid").alias("jid"), F.min_by("th", "jid").alias("th"))
    left = classes.join(alone, "key", "left").filter(F.coalesce("alone", F.lit(0)) <= _missing(F.col("n"), num, den)).select("key", "jid", "th")
    left = C.written(left, "left")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            keys, sets, bits = [], [], []
            for wanted, found in zip(batch.column("key").to_pylist(), shingle_sets(batch.column("text"), k)):
                if len(found) and _key(found) == wanted:  # another text may have the same hash
                    keys.append(wanted)
                    sets.append(found.view(np.int64))
                    parity = np.bincount((found >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1
                    bits.append(np.packbits(parity.astype(np.uint8)).tobytes())
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int64), *sets])), pa.array(bits, pa.binary())], ["key", "n", "set", "bits"])

    one = _small(left)
    again = text.select("jid", "th", "text").join(one, ["jid", "th"]).select("key", "text")
    if some.select("jid", "th").join(one, ["jid", "th"]).count() > left.count():  # rows that repeat an id and its text
        again = again.dropDuplicates(["key"])
    schema = "key long, n long, set array<long>, bits binary"
    sets = C.written(again.mapInArrow(whole, schema), "whole")
    few = C.written(rows.select("doc_id", "jid", "th", "n", "key"), "classes")
    C.forget(rows, left)
    return few, sets


def _prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Step 2: (token, key, n, own, l, level), a row for each shingle of each class's l-prefix that others have too.

    own: shingles that no other class has; these come first in the order. A shingle has level j if it belongs to the
    j-prefix but to no shorter one.
    """
    each = sets.select("key", F.explode("set").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    total = sets.agg(F.sum("n")).first()[0] or 0
    lists = C.spread_join(each, shared, "token", "df", total, F.xxhash64("key")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))  # of one set's shingles
    e = _missing(F.col("n"), num, den)
    rows = sets.select("key", "n").join(lists, "key").withColumn("own", F.col("n") - F.size("s")).withColumn("e", e).filter("own <= e")
    rows = rows.withColumn("s", F.expr(f"slice(s, 1, cast(greatest(0, e + {MOST_MATCHES} - own) as int))"))
    # estimated cost of l: its lists' lengths, and the verification of at most an l-th as many candidates
    length = "aggregate(slice(s, 1, cast(greatest(0, e + {0} - own) as int)), 0L, (a, x) -> a + x.df)"
    costs = [f"named_struct('c', {length.format(j)} * (1 + {VERIFY_COST} / {j}D), 'l', {j})" for j in range(1, MOST_MATCHES + 1)]
    # linked sets share n - e shingles at least, and may share no more: l is bounded by that
    rows = rows.withColumn("l", F.expr(f"array_min(filter(array({', '.join(costs)}), x -> x.l <= n - e)).l"))
    rows = rows.select("key", "n", "own", "l", "e", F.posexplode("s").alias("i", "x")).withColumn("level", F.greatest(F.lit(1), F.col("own") + F.col("i") + 1 - F.col("e")).cast("int"))
    return rows.filter("level <= l").select(F.col("x.token").alias("token"), "key", "n", "own", "l", "level")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose similarity is at least num / den, exactly."""
    a, b = (sets.select(F.col("key").alias(c), F.col("set").alias(f"set_{c}")) for c in "xy")
    both = pairs.select("x", "y").join(a, "x").join(b, "y")
    inter = F.size(F.array_intersect("set_x", "set_y")).cast("long")
    return both.select("x", "y", inter.alias("i"), (F.size("set_x") + F.size("set_y")).cast("long").alias("n")).filter(F.col("i") * den >= (F.col("n") - F.col("i")) * num).select("x", "y")


def _may_link(n1, n2, own, differ, num: int, den: int):
    """Bounds on a pair: sizes, and shingles in which they differ at least (own ones, or bits of their bitmaps)."""
    total = n1 + n2
    return (np.minimum(n1, n2) * den >= np.maximum(n1, n2) * num) & (own * (den + num) <= total * (den - num)) & (differ * (den + num) <= total * (den - num))


def _hub_links(prefixes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Step 3: links (x, hub)."""
    first = prefixes.filter("level = 1")
    order = F.struct(F.round(F.col("own") / F.col("n"), 2).alias("share"), "key")
    hubs = first.groupBy("token").agg(F.min(order).alias("hub"), F.count("*").alias("members")).filter("members > 1")
    pairs = C.spread_join(first, hubs, "token", "members", prefixes.count(), F.xxhash64("key")).select(F.col("key").alias("x"), F.col("hub.key").alias("y")).filter("x != y").distinct()
    narrow = [sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "xy"]

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = [_bitmaps(batch.column(c)) for c in ("bitsx", "bitsy")]
                differ = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
                keep = _may_link(*(batch.column(c).to_numpy() for c in ("nx", "ny")), 0, differ, num, den)
                yield batch.select(["x", "y"]).filter(pa.array(keep))

    near = pairs.join(narrow[0], "x").join(narrow[1], "y").mapInArrow(passing, "x long, y long")
    return _verified(near, sets, num, den)


def _bitmaps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _other_links(prefixes: DataFrame, roots: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Step 4: the links (x, y) between the components that the hubs have made; roots: (key, root)."""
    rows = C.written(prefixes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "members")
    lists = rows.groupBy("token").agg(F.count("*").alias("members"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("token", "members")
    # a long list is cut by size, so that links lie within a cut or between neighbours, and each cut into blocks
    long = F.col("members") > BLOCK
    size = F.floor(F.log("n") / (float(np.log(den / num)) * (1 + 1e-9))) if den > num else F.col("n")
    listed = C.written(C.spread_join(rows, lists, "token", "members", rows.count(), F.xxhash64("key")).withColumn("size", F.when(long, size).otherwise(0).cast("int")), "members")
    cuts = listed.filter(long).groupBy("token", "size").agg(F.count("*").alias("n")).groupBy("token")
    cuts = cuts.agg(F.map_from_entries(F.collect_list(F.struct("size", F.ceil(F.col("n") / BLOCK).cast("int")))).alias("cut"), F.sum("n").alias("members"))
    inlong = C.spread_join(listed.filter(long).drop("members"), cuts, "token", "members", listed.count(), F.xxhash64("key"))
    rows = inlong.drop("members").unionByName(listed.filter(~long).drop("members").withColumn("cut", F.create_map(F.lit(0), F.lit(1))))
    # each pair of blocks is a group of its own
    rows = rows.withColumn("at", F.pmod(F.xxhash64("key", "token"), F.expr("try_element_at(cut, size)")).cast("int"))
    others = "transform(sequence(0, coalesce(try_element_at(cut, size + {0}), 0)), j -> named_struct('c', size + least(0, {0}), 'i', {1}, 'd', size + greatest(0, {0}), 'j', {2}, 'side', {3}, 'alone', {4}))"
    cells = [others.format(0, "least(at, j)", "greatest(at, j)", "at <= j", "at = j"), others.format(1, "at", "j", "true", "false"), others.format(-1, "j", "at", "false", "false")]
    rows = rows.withColumn("cell", F.explode(F.expr("concat(" + ", ".join(f"slice({x}, 1, coalesce(try_element_at(cut, size + {d}), 0))" for x, d in zip(cells, (0, 1, -1))) + ")")))
    rows = rows.withColumn("group", F.xxhash64("token", "cell.c", "cell.i", "cell.d", "cell.j")).withColumn("side", F.col("cell.side").cast("int")).withColumn("alone", F.col("cell.alone"))
    rows = rows.join(sets.select("key", "bits"), "key").select("group", "side", "alone", "key", "n", "own", "l", "level", "root", "bits")
    rows = rows.repartition("group").sortWithinPartitions("group")

    def compare(t: dict[str, np.ndarray], bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = len(t["key"])
        inside = bool(t["alone"][0])
        for i in range(n):
            # within a block each pair once; between two blocks from the one to the other
            js = np.arange(i + 1, n) if inside else np.flatnonzero(t["side"] == 0) if t["side"][i] else ()
            if not len(js):
                continue
            l = np.minimum(t["l"][i], t["l"][js])
            js = js[(t["root"][js] != t["root"][i]) & (np.maximum(t["level"][i], t["level"][js]) <= l)]
            js = js[_may_link(t["n"][i], t["n"][js], t["own"][i] + t["own"][js], 0, num, den)]
            if len(js):
                js = js[_may_link(t["n"][i], t["n"][js], 0, np.bitwise_count(bits[js] ^ bits[i]).sum(1, dtype=np.int64), num, den)]
                yield np.full(len(js), t["key"][i]), t["key"][js], np.minimum(t["l"][i], t["l"][js])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # the last group may go on in the next batch; a group has 2 * BLOCK rows or so
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            group = table.column("group").to_numpy()
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            yield from groups(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield from groups(rest)

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        t = {c: table.column(c).to_numpy() for c in ("group", "side", "alone", "key", "n", "own", "l", "level", "root")}
        bits = _bitmaps(table.column("bits").combine_chunks())
        cuts = np.flatnonzero(np.concatenate([[True], t["group"][1:] != t["group"][:-1], [True]]))
        found = [f for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) for f in compare({c: v[a:b] for c, v in t.items()}, bits[a:b])]
        if found:
            x, y, l = (np.concatenate(c) for c in zip(*found))
            pairs, times = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y), l]), axis=1, return_counts=True)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2].astype(np.int32)), pa.array(times)], ["x", "y", "l", "times"])

    found = rows.mapInArrow(search, "x long, y long, l int, times long")
    pairs = found.groupBy("x", "y").agg(F.sum("times").alias("shared"), F.min("l").alias("l")).filter("shared >= l")
    return _verified(pairs, sets, num, den)


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every key in links (x, y): root is the least key of its connected component.

    Alternating large and small stars: each round a few joins, a number of rounds that grows with the logarithm of
    the component's size. Every round, and the result, is a written table.
    """
    edges = C.written(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u != v").distinct(), "edges")
    state, by = None, F.xxhash64("u", "v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = C.spread_join(both, least, "u", "n", 2 * edges.count(), by).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = C.written(large.distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = C.spread_join(large, least, "u", "n", large.count(), by).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, C.written(small.filter("u != v").distinct(), "edges")
        C.forget(before, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    found = edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
    out = C.written(found, "roots")
    C.forget(edges)
    return out


def _labelled(docs: DataFrame, k: int, threshold: tuple[int, int], label: Column) -> DataFrame:
    """(doc_id, jid, th, n, label) of every row; label is the least that any row of its component has.

    Where n is 0, a row is a component of its own, and label is null.
    """
    num, den = threshold
    rows, sets = _tables(docs, k, num, den)
    prefixes = C.written(_prefixes(sets, num, den), "prefixes")
    by_hub = C.written(_hub_links(prefixes, sets, num, den), "links")
    roots = components(by_hub)
    others = C.written(_other_links(prefixes, roots, sets, num, den), "links")
    if others.take(1):
        star, roots = roots, components(roots.select(F.col("key").alias("x"), F.col("root").alias("y")).unionByName(others))
        C.forget(star)
    C.forget(sets, prefixes, by_hub, others)
    some = rows.filter("n > 0")
    classes = some.groupBy("key").agg(F.min(label).alias("least"), F.count("*").alias("rows"))
    joined = roots.join(classes, "key").select("key", "root", "least")
    least = joined.groupBy("root").agg(F.min("least").alias("label"), F.count("*").alias("classes"))
    changed = C.spread_join(joined.select("key", "root"), least, "root", "classes", roots.count(), F.xxhash64("key")).select("key", "label")
    labels = classes.join(changed, "key", "left").select("key", F.coalesce("label", "least").alias("label"), "rows")
    linked = C.spread_join(some, labels, "key", "rows", rows.count(), F.monotonically_increasing_id()).select("doc_id", "jid", "th", "n", "label")
    return linked.unionByName(rows.filter("n = 0").select("doc_id", "jid", "th", "n").withColumn("label", F.lit(None)))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; threshold is a fraction (numerator, denominator).

    component_id is the least doc_id that links reach, the own one included. A null or empty text, or one without
    words, has no shingles and is linked with nothing. Rows with a null doc_id take part (component_id is null only
    if no row of the component has a doc_id); repeated rows give a row each; other columns are ignored.
    """
    found = _labelled(docs, k, threshold, F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents, with all their columns, less near duplicates: of each component exactly one row stays.

    It is a row with the least doc_id (without any doc_id in the component, one without), of several texts with that
    doc_id the one with the least hash. Rows are decided one by one: an id may occur with several texts, and those in
    different components all stay. Rows that repeat doc_id and text are one document, of which one row stays, whatever
    their other columns. Texts without words have no copies: with a doc_id they stay once, without one they all stay.
    """
    found = _labelled(docs, k, threshold, F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th"))
    found = C.written(found.select("doc_id", "jid", "th", "n", F.col("label.doc_id").alias("first_id"), F.col("label.th").alias("first_th")), "labels")
    names = ["_join_id", "_join_text"]
    rows = found.select("doc_id", "n", "first_id", "first_th", F.col("jid").alias(names[0]), F.col("th").alias(names[1]))
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col(names[1]) == F.col("first_th"))
    dropped = C.written(rows.filter((F.col("n") > 0) & ~first).select(*names).distinct(), "dropped")
    again = C.written(rows.filter(F.col("doc_id").isNotNull() | (F.col("n") > 0)).groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1").select(*names), "again")
    C.forget(found)
    jid, th = _row_keys(docs)
    out = docs.select("*", jid.alias(names[0]), th.alias(names[1])).join(_small(dropped), names, "left_anti")
    if again.take(1):
        again = _small(again)
        out = out.join(again, names, "left_anti").unionByName(out.join(again, names, "left_semi").dropDuplicates(names))
    return out.select(*docs.columns)
