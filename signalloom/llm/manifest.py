"""A Merkle manifest of a dataset: leaves placed by bitmap rank, levels reduced in keyed slot arrays.

A row is a leaf. The leaves of a group (a language, say) stand in the order of their ids; runs of two, the last of one
perhaps, become the digest of both, level by level, down to the group's root, and the groups' roots become the root alike.

Where a leaf stands is a rank: how many ids of its group are smaller. Nothing is sorted for that. The ids of a group are a
bitmap, kept as its words of 64 bits that have any bit; partial words of the same place merge by ``or``. A directory holds
what is before each word: words are counted by runs of 512, these by runs of 512 again, until one run holds a group, and
the counts before a run are handed down again. The rank is the directory's count and the bits below the id in its word.
Rows that share an id, and those without, are ranked among themselves by their digests; only they are dealt by ranges.

A leaf's coordinate names a slot of an array of 1,024: one row holds ten levels of the tree, and arrays of arrays' roots the
next ten. Every step is of DataFrame functions; a group, a word, a run and an array have bounded sizes, whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.common import few, materialize, shuffle_partitions

WORD_BITS, RUN_BITS, SLOT_BITS = 6, 9, 10


def digest(*inputs: Column) -> Column:
    """The lower-case hex SHA-256 of the inputs, concatenated."""
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes in UTF-8, a colon, and the value; integers are decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def _shift(op: str, value: Column, bits: Column | int) -> Column:
    return F.call_function(op, value, F.lit(bits) if isinstance(bits, int) else bits)


def _up(value: Column, bits: int) -> Column:
    return _shift("shiftright", value, bits)


# --- coordinates by bitmap rank ----------------------------------------------------------------------------------


def words_of(ids: DataFrame) -> DataFrame:
    """(grp, word, bits, rows, more) of ids(grp, id): a bitmap of the ids of each group, in its words that are not zero.

    rows counts the rows of a word's ids, and more has the surplus of those that repeat, as (low, surplus), 64 at most.
    """
    low = F.col("id").bitwiseAND(F.lit(63)).cast("int")
    each = ids.groupBy("grp", _up(F.col("id"), WORD_BITS).alias("word"), low.alias("low")).agg(F.count("*").alias("k"))
    surplus = F.when(F.col("k") > 1, F.struct("low", (F.col("k") - 1).alias("surplus")))
    bit = _shift("shiftleft", F.lit(1).cast("long"), F.col("low"))
    return each.groupBy("grp", "word").agg(F.bit_or(bit).alias("bits"), F.sum("k").alias("rows"), F.collect_list(surplus).alias("more"))


def directory(words: DataFrame) -> DataFrame:
    """(grp, word, before): how many rows of the group have an id in a smaller word.

    Runs of 512 words, of 512 runs and so on are summed until no group has more than that; no task sees more of one at once.
    """
    first, last = words.agg(F.min("word"), F.max("word")).first()
    levels = [words.select("grp", F.col("word").alias("at"), "rows")]
    while first is not None and last - first >= 1 << RUN_BITS:
        first, last = first >> RUN_BITS, last >> RUN_BITS
        up = levels[-1].groupBy("grp", _up(F.col("at"), RUN_BITS).alias("at")).agg(F.sum("rows").alias("rows"))
        levels.append(materialize(up, "runs"))

    def so_far(*keys: str | Column) -> Column:
        return F.coalesce(F.sum("rows").over(Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    before = levels.pop().select("grp", "at", so_far("grp").alias("before"))
    while levels:
        run = _up(F.col("at"), RUN_BITS)
        level = levels.pop().select("grp", "at", run.alias("run"), so_far("grp", run).alias("within"))
        above = before.select("grp", F.col("at").alias("run"), F.col("before").alias("above"))
        before = level.join(above, ["grp", "run"]).select("grp", "at", (F.col("above") + F.col("within")).alias("before"))
        if levels:
            before = materialize(before, "directory")
    return before.withColumnRenamed("at", "word")


def _rank(low: Column) -> Column:
    """Rows of smaller ids: those of the words before, the bits below, and the surplus of repeated ids below."""
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(_shift("shiftleft", F.lit(-1).cast("long"), low))))
    more = F.filter("more", lambda x: x["low"] < low)
    return F.col("before") + below + F.aggregate(more, F.lit(0).cast("long"), lambda a, x: a + x["surplus"])


def _numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """df, a written table, with at: the place of each row in the order, from 0; equal rows stand in any order.

    Dealt by ranges, in which even equal rows may part, and counted on from range to range: no task sees a whole group.
    """
    df = df.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    dealt = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order, "spread")
    dealt = dealt.sortWithinPartitions(*order, "spread").drop("spread")
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = _up(F.col("at"), 33).alias("part")
    so_far = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    counts = dealt.groupBy(part).count().select("part", F.coalesce(so_far, F.lit(0)).alias("base"))
    dealt = dealt.select("*", part).join(F.broadcast(counts), "part")
    return dealt.withColumn("at", F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "base")


def _among_equals(tied: DataFrame) -> DataFrame:
    """tied with nth: the place of a row among those of its grp and id, by digest."""
    dealt = materialize(_numbered(tied, "grp", F.col("id").asc_nulls_first(), "digest"), "tied")
    first = materialize(dealt.groupBy("grp", "id").agg(F.min("at").alias("first")), "ties")
    same = F.col("a.grp").eqNullSafe(F.col("b.grp")) & F.col("a.id").eqNullSafe(F.col("b.id"))
    found = dealt.alias("a").join(few(first).alias("b"), same)
    return found.select("a.*", (F.col("a.at") - F.col("b.first")).alias("nth")).drop("at")


def place(leaves: DataFrame) -> DataFrame:
    """leaves(grp, id, digest, ...) with slot, from 0 in each group, and n, the size of the group.

    Rows without an id come first, equal ids by digest. leaves must be a written table; grp is not null.
    """
    words = materialize(words_of(leaves.where("id is not null").select("grp", "id")), "words")
    ranks = materialize(words.join(directory(words), ["grp", "word"]).select("grp", "word", "bits", "more", "before"), "rank-of-words")
    groups = leaves.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("none"))
    groups = few(materialize(groups, "groups"))

    with_id = leaves.where("id is not null").withColumn("word", _up(F.col("id"), WORD_BITS))
    low = F.col("id").bitwiseAND(F.lit(63)).cast("int")
    found = with_id.join(ranks, ["grp", "word"])
    found = found.select(*leaves.columns, _rank(low).alias("rank"), F.exists("more", lambda x: x["low"] == low).alias("tied"))
    without = leaves.where("id is null").select("*", F.lit(None).cast("long").alias("rank"), F.lit(True).alias("tied"))
    found = materialize(found.unionByName(without), "ranks")
    placed = found.where("not tied").withColumn("nth", F.lit(0).cast("long"))
    tied = found.where("tied")
    if not tied.isEmpty():
        placed = placed.unionByName(_among_equals(materialize(tied, "ties")))
    slot = F.coalesce(F.col("rank") + F.col("none"), F.lit(0)) + F.col("nth")
    return placed.join(groups, "grp").select(*leaves.columns, slot.alias("slot"), "n")


# --- levels in slot arrays ---------------------------------------------------------------------------------------


def _levels(slots: Column, n: Column) -> Column:
    """All levels of an array of digests, itself first: ten, or as many as leave one of a group of n."""
    steps = F.when(n > 1, F.least(F.length(F.bin(n - 1)), F.lit(SLOT_BITS))).otherwise(0)
    halves = lambda level: F.transform(
        F.sequence(F.lit(0), ((F.size(level) - 1) / 2).cast("int")),
        lambda i: digest(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))),
    )
    up = lambda levels, _: F.concat(levels, F.array(halves(F.element_at(levels, -1))))
    return F.aggregate(F.array_repeat(F.lit(0), steps), F.array(slots), up)


def _siblings(levels: Column, at: Column) -> Column:
    """(digest, left) for each level but the last, from the slot upwards: the sibling, null for a node alone, and its side."""
    return F.transform(
        F.slice(levels, 1, F.size(levels) - 1),
        lambda level, up: F.struct(
            F.get(level, _up(at, up).bitwiseXOR(F.lit(1))).alias("digest"), (_up(at, up).bitwiseAND(F.lit(1)) == 1).alias("left")
        ),
    )


def fold(start: Column, path: Column) -> Column:
    """The root that a digest has with a path of siblings."""
    alone, left = lambda s: s["digest"].isNull(), lambda s: s["left"]
    step = lambda x, s: F.when(alone(s), digest(x)).when(left(s), digest(s["digest"], x)).otherwise(digest(x, s["digest"]))
    return F.aggregate(path, start, step)


def proof(path: Column) -> Column:
    """The digest of the siblings of a path, one after the other."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), ""), 256)


def _climb(leaves: DataFrame, own: list[str]) -> list[DataFrame]:
    """Slot arrays of leaves(grp, slot, n, digest, and the columns of own), of the arrays' roots, and so on to one array a group."""
    biggest, passes = leaves.agg(F.max("n")).first()[0] or 0, []
    rows, held = leaves, ["slot", "digest", *own]
    while not passes or biggest > 1:
        block = _up(F.col("slot"), SLOT_BITS).alias("block")
        arrays = rows.groupBy("grp", block).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct(*held))).alias("held"))
        arrays = arrays.withColumn("levels", _levels(F.col("held.digest"), F.col("n")))
        arrays = materialize(arrays.withColumn("top", F.get(F.element_at("levels", -1), F.lit(0))), "slots")
        passes.append(arrays)
        biggest = -(-biggest >> SLOT_BITS)
        n = F.ceil(F.col("n") / (1 << SLOT_BITS)).cast("long").alias("n")
        rows, held = arrays.select("grp", F.col("block").alias("slot"), n, F.col("top").alias("digest")), ["slot", "digest"]
    return passes


def _descend(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves of the first pass, each with path, and with what above(grp, block, path, ...) has for its group besides.

    above has a row for each array of the last pass; each array is joined to its one row, so no key is hot.
    """
    more = above.columns[3:]
    for arrays in reversed(passes):
        own = arrays.schema["held"].dataType.elementType.names
        joined = arrays.select("grp", "block", "held", "levels").join(above, ["grp", "block"])
        each = joined.select("grp", "levels", F.col("path").alias("rest"), *more, F.explode("held").alias("x"))
        at = F.col("x.slot").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int")
        path = F.concat(_siblings(F.col("levels"), at), F.col("rest")).alias("path")
        found = each.select("grp", *(F.col(f"x.`{c}`") for c in own), path, *more)
        if arrays is not passes[0]:
            above = materialize(found.select("grp", F.col("slot").alias("block"), "path", *more), "paths")
    return found


def _group_paths(tops: DataFrame) -> DataFrame:
    """(grp, block, path, subroot, root) of tops(grp, top): the tree over the groups, which stand in the order of grp."""
    tops = materialize(tops, "subroots")
    count = tops.count()
    placed = _numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("digest")), "name")
    passes = _climb(placed.select("grp", F.col("at").alias("slot"), F.lit(count).cast("long").alias("n"), "digest", "name"), ["name"])
    none = F.array().cast("array<struct<digest:string,left:boolean>>")
    found = _descend(passes, passes[-1].select("grp", "block", none.alias("path"), F.col("top").alias("root")))
    found = found.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root")
    return materialize(found, "group-paths")


def build(docs: DataFrame, fields: list[str], group: str, key: str, **others: Column) -> DataFrame:
    """The manifest of docs: key, leaf, subroot, root, path and the columns of others, a row for each row of docs.

    A leaf is the digest of the fields (see ``field``) in their order. Leaves of a group are in ascending order of the integer
    key: rows without a key first, rows that share one by their digests. Groups are in ascending order of their text, bytewise,
    null first. path has the siblings from the leaf to the root, as (digest, left): left if the sibling stands before, and with
    a null digest where a node is alone in its run. others are columns of docs that come along, of types that order, such as
    digests of changed rows. Other columns of docs play no part; an empty table gives an empty manifest. Rows that are equal
    in every way have places of their own next to each other, so their paths differ.
    """
    grp = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))
    own = F.struct(F.col(f"`{key}`").alias("key"), *(c.alias(name) for name, c in others.items()))
    values = leaf(*(F.col(f"`{c}`") for c in fields))
    rows = docs.select(grp.alias("grp"), F.col(f"`{key}`").cast("long").alias("id"), values.alias("digest"), own.alias("own"))
    placed = place(materialize(rows, "leaves"))
    passes = _climb(placed.select("grp", "slot", "n", "digest", "own"), ["own"])
    found = _descend(passes, _group_paths(passes[-1].select("grp", "top")))
    return found.select(
        F.col("own.key").alias(key),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "path",
        *(F.col(f"own.`{name}`").alias(name) for name in others),
    )
