"""Rows of one block whose word sets are nearly equal, and groups of rows that may be one procurement.

Equal sets of a block are one node. Words are coded by their order, rare before frequent. In a block of few nodes all pairs
meet. In a larger one, two sets that share c words at least have their first l common words among the first n - c + l of
each, and such l words make a bucket. Two short sets know from their sizes how many words they must share, so each pair of
sizes has buckets of its own, in which the shorter sets meet the longer ones: with l = c whoever meets is near. Longer
sets meet in buckets of three words, or of two or one where three of a set would be too many. A pair is kept in the bucket
of its first common words alone. There it is dropped where sizes or a parity sketch of 64 bits (the bits in which two
sketches differ never exceed the words in which the sets differ) rule it out; what remains is compared exactly, in place.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.operators.components import groups
from kelpie.session import stored

#: Nodes of a part of a bucket of long sets. A larger bucket is dealt in parts, and each two parts are a key of their own.
PART_NODES = 1_000
#: Buckets of a set, for each size it may meet; one with more takes buckets of fewer words.
MOST_BUCKETS = 24
#: Buckets of a short set in all, its largest size, and the most words of its buckets.
MOST_KEYS, MOST_SIZE, MOST_PICKED = 128, 32, 8
#: In a block of no more nodes all pairs meet.
BLOCK_NODES = 1_024
#: Up to so many different words are coded by one list of them all, more by a join.
LISTED_WORDS = 256
#: Up to so many blocks that hold a row asked about are sent to all tasks.
SENT_BLOCKS = 200_000


def _in_order(words: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(words, F.array().cast("array<string>")))))


def _classes(rows: DataFrame, keys: list[str], id_: str, asked: str) -> DataFrame:
    """One row per value of keys: the rows of it, those asked about, the least id."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(asked).alias("asked"), F.min(id_).alias("first_id"))


def word_nodes(df: DataFrame, block: list[str], words: str, id_: str, asked: str) -> DataFrame:
    """One row per block and set of words: node (128 bits of both), words in order, their number, the rows of it, those
    asked about, and the least id. Null blocks and sets without words are left out."""
    named = df.select(*block, id_, asked, _in_order(words).alias("words")).dropna(subset=block).filter(F.size("words") > 0)
    once = _classes(named, [*block, "words"], id_, asked)
    return once.withColumns({"node": F.md5(F.to_json(F.struct(*block, "words"))), "n": F.size("words")})


def _ordered(df: DataFrame, key: str) -> DataFrame:
    """df with order: the codes of its words, ascending, those of the fewest rows first. key tells sets of words apart."""
    counts = df.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("held"))
    listed = counts.limit(LISTED_WORDS + 1).collect()
    if len(listed) <= LISTED_WORDS:
        every = F.array(*[F.lit(w) for _, w in sorted((r.held, r.word) for r in listed)]).cast("array<string>")
        return df.withColumn("order", F.sort_array(F.transform("words", lambda w: F.array_position(every, w).cast("int"))))
    codes = stored(counts.orderBy("held", "word").select("word", F.monotonically_increasing_id().alias("code")), "codes")
    each = df.select(key, "words").dropDuplicates([key]).select(key, F.explode("words").alias("word"))
    order = each.join(codes, "word").groupBy(key).agg(F.sort_array(F.collect_list("code")).alias("order"))
    return df.join(order, key, "left").withColumn("order", F.coalesce("order", F.array().cast("array<bigint>")))


def _level(n: str, percent: int) -> str:
    """How many words make a bucket of a long set of n, as SQL: no more than a near set of any size must share with it."""
    shared = f"(({percent} * {n} + 99) div 100)"
    three, two = (f"({n} - {shared} + {k})" for k in (3, 2))
    return (
        f"CASE WHEN {shared} >= 3 AND {three} * ({three} - 1) * ({three} - 2) <= {6 * MOST_BUCKETS} THEN 3"
        f" WHEN {shared} >= 2 AND {two} * ({two} - 1) <= {2 * MOST_BUCKETS} THEN 2 ELSE 1 END"
    )


def _buckets(block: list[str], percent: int) -> str:
    """The buckets of a long set, as SQL: those of its own level, and of the levels at which near sets of other sizes look."""
    key = lambda level, *words: f"xxhash64({', '.join([*block, str(level), *words])})"
    lead = lambda level: f"slice(order, 1, n - (({percent} * n + 99) div 100) + {level})"
    after = lambda level, place: f"slice({lead(level)}, {place}, n + 1)"
    made = {
        1: f"transform({lead(1)}, x -> {key(1, 'x')})",
        2: f"flatten(transform({lead(2)}, (x, i) -> transform({after(2, 'i + 2')}, y -> {key(2, 'x', 'y')})))",
        3: f"flatten(transform({lead(3)}, (x, i) -> flatten(transform({after(3, 'i + 2')}, (y, j) -> transform({after(3, 'i + j + 3')}, z -> {key(3, 'x', 'y', 'z')})))))",
    }
    levels = f"array_distinct(transform(sequence(({percent} * n + 99) div 100, (100 * n) div {percent}), m -> least({_level('n', percent)}, {_level('m', percent)})))"
    return f"array_distinct(flatten(transform({levels}, l -> CASE l WHEN 3 THEN {made[3]} WHEN 2 THEN {made[2]} ELSE {made[1]} END)))"


@cache
def _meetings(percent: int) -> tuple[int, list[tuple[int, ...]]]:
    """(largest size of a short set, rows of its size, the two sizes of a pair, the words l of a bucket, and l places)."""
    largest, rows = 0, []
    for n in range(1, MOST_SIZE + 1):
        mine = []
        for m in range(-(-percent * n // 100), 100 * n // percent + 1):
            shared = -(-percent * (n + m) // (100 + percent))
            if n == m == shared:  # equal sets are one node
                continue
            # a bucket of one word is always allowed
            picked = next(k for k in range(min(shared, MOST_PICKED), 0, -1) if k == 1 or comb(max(n, m) - shared + k, k) <= MOST_BUCKETS)
            mine += [(n, min(n, m), max(n, m), picked, *places, *[-1] * (MOST_PICKED - picked)) for places in combinations(range(n - shared + picked), picked)]
        if len(mine) > MOST_KEYS:
            break
        largest, rows = n, rows + mine
    return largest, [r for r in rows if r[2] <= largest]


def _pairs_of_short_sets(sets: DataFrame, block: list[str], percent: int) -> DataFrame:
    """Pairs (a, b) of short sets of crowded blocks."""
    largest, rows = _meetings(percent)
    places = [f"place{k}" for k in range(MOST_PICKED)]
    known = sets.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows or [(0,) * (4 + MOST_PICKED)]))} AS t({', '.join(['n', 'low', 'high', 'picked', *places])})")
    # sizes and words of a bucket are one column, so that less is sent
    starts = sets.filter(F.col("n") <= largest).join(F.broadcast(known), "n").withColumn("kind", F.expr("(low * 100 + high) * 100 + picked"))
    starts = starts.withColumn("key", F.xxhash64(*block, "kind", *[F.get("order", F.col(p)) for p in places]))
    sides = [starts.filter(F.col("n") == F.col(size)).drop("n", "low", "high", "picked", "crowded", *places).alias(s) for s, size in (("a", "low"), ("b", "high"))]
    common = F.array_intersect("a.order", "b.order")
    n, m, picked = F.size("a.order"), F.size("b.order"), F.col("a.kind") % 100
    here = F.xxhash64(*[f"a.{c}" for c in block], "a.kind", *[F.when(picked > k, F.get(common, F.lit(k))) for k in range(MOST_PICKED)])
    once = (n != m) | (F.col("a.node") < F.col("b.node"))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ["key", "kind", *block]]
    return sides[0].join(sides[1], _all([*same, F.col("a.wanted") | F.col("b.wanted"), once, _sketched(percent, n, m), _near(percent, n, m, common), here == F.col("a.key")]))


def _pairs_of_long_sets(sets: DataFrame, block: list[str], percent: int, part_nodes: int) -> DataFrame:
    """Pairs (a, b) of sets of crowded blocks, of which one at least is long."""
    largest, _ = _meetings(percent)
    starts = sets.filter(100 * F.col("n") > percent * largest).withColumn("key", F.explode(F.expr(_buckets(block, percent))))
    large = starts.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > part_nodes)  # one row for so many buckets at least
    dealt = starts.join(F.broadcast(large), "key", "left").withColumn("parts", F.expr(f"coalesce(cast(ceil(size / {part_nodes}) as int), 1)")).drop("size")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"lower": F.least("part", "other"), "upper": F.greatest("part", "other")}).drop("parts", "other")

    # both sides of the join are the same rows, so that they are sent once; what tells the sides apart names both
    a, b = dealt.alias("a"), dealt.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    sides = (F.col("a.part") - F.col("a.lower") + F.col("b.upper") - F.col("b.part")) == 0  # a is of the lower part, b of the upper one
    once = (F.col("a.lower") != F.col("b.upper")) | (F.col("a.node") < F.col("b.node"))  # two parts meet once anyway
    common = F.array_intersect("a.order", "b.order")
    level = F.least(F.expr(_level("a.n", percent)), F.expr(_level("b.n", percent)))
    own = [F.col(f"a.{c}") for c in block]
    first = [F.get(common, F.lit(k)) for k in range(3)]
    here = F.when(level == 3, F.xxhash64(*own, F.lit(3), *first)).when(level == 2, F.xxhash64(*own, F.lit(2), *first[:2])).otherwise(F.xxhash64(*own, F.lit(1), first[0]))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ["key", "lower", "upper", *block]]
    long = (n > largest) | (m > largest)
    return a.join(b, _all([*same, sides, once, long, F.col("a.wanted") | F.col("b.wanted"), *_sizes(percent, n, m), _sketched(percent, n, m), _near(percent, n, m, common), here == F.col("a.key")]))


def _pairs_of_blocks(sets: DataFrame, block: list[str], percent: int) -> DataFrame:
    """Pairs (a, b) of the sets of each block."""
    a, b = sets.alias("a"), sets.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in block]
    return a.join(b, _all([*same, F.col("a.node") < F.col("b.node"), _sketched(percent, n, m), *_sizes(percent, n, m), F.col("a.wanted") | F.col("b.wanted"), _near(percent, n, m, F.array_intersect("a.order", "b.order"))]))


def near_pairs(nodes: DataFrame, block: list[str], percent: int, part_nodes: int = PART_NODES, carry: list[str] | None = None) -> DataFrame:
    """(u, v): all pairs of different nodes of a block with |A and B| / |A or B| >= percent / 100, of which one at least is
    asked about; u < v, each once. Columns in carry are given of both, as u_<name> and v_<name>."""
    carry, named = carry or [], [f"block{k}" for k in range(len(block))]
    if "order" not in nodes.columns:
        nodes = stored(_ordered(nodes, "node"), "ordered")
    sketch = F.expr("aggregate(order, 0L, (a, w) -> a ^ shiftleft(1L, cast(pmod(xxhash64(w), 64) as int)))")
    sets = nodes.select(*[F.col(c).alias(b) for c, b in zip(block, named, strict=True)], "node", F.size("order").alias("n"), sketch.alias("sketch"), (F.col("asked") > 0).alias("wanted"), "order", *[F.col(c).alias(f"own_{c}") for c in carry])
    crowded = sets.groupBy(*named).agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK_NODES).select(*named, F.lit(True).alias("crowded"))
    sets = sets.join(F.broadcast(crowded), named, "left")
    many = sets.filter("crowded").drop("crowded")
    met = [_pairs_of_blocks(sets.filter("crowded IS NULL").drop("crowded"), named, percent), _pairs_of_short_sets(many, named, percent), _pairs_of_long_sets(many, named, percent, part_nodes)]
    out = None
    for pairs in met:
        x, y = (F.struct(F.col(f"{s}.node").alias("node"), *[F.col(f"{s}.own_{c}").alias(c) for c in carry]) for s in "ab")
        forth = F.col("a.node") < F.col("b.node")
        ends = pairs.select(F.when(forth, x).otherwise(y).alias("x"), F.when(forth, y).otherwise(x).alias("y"))
        out = ends if out is None else out.union(ends)
    return out.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), *[F.col(f"{s}.{c}").alias(f"{e}_{c}") for s, e in ("xu", "yv") for c in carry])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _sizes(percent: int, n: Column, m: Column) -> list[Column]:
    return [100 * n >= percent * m, 100 * m >= percent * n]


def _sketched(percent: int, n: Column, m: Column) -> Column:
    return F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch"))) * (100 + percent) <= (100 - percent) * (n + m)


def _near(percent: int, n: Column, m: Column, common: Column) -> Column:
    return F.size(common) * (100 + percent) >= percent * (n + m)


def _by_words(rows: DataFrame, block: list[str], id_: str, percent: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(ids with such a link, links between ids that join the same groups)."""
    rows = rows.select(id_, "wanted_", *block, "said", "order").dropna(subset=[*block, "said"])
    live = stored(rows.filter("wanted_").select(*block).distinct(), f"{name}-blocks")  # nothing is linked in the others
    rows = rows.join(F.broadcast(live) if live.count() <= SENT_BLOCKS else live, block, "left_semi")
    nodes = _classes(rows, [*block, "said", "order"], id_, "wanted_").withColumn("node", F.monotonically_increasing_id())
    nodes = stored(nodes, f"{name}-nodes")
    pairs = stored(near_pairs(nodes, block, percent, carry=["asked", "first_id"]), f"{name}-pairs")
    ends = pairs.select("u", F.col("v_asked").alias("by")).union(pairs.select("v", F.col("u_asked").alias("by")))
    flags = ends.groupBy(F.col("u").alias("node")).agg(F.max(F.col("by") > 0).alias("by_asked"))
    known = nodes.join(flags, "node", "left").withColumns({"met": F.col("by_asked").isNotNull(), "by_asked": F.coalesce("by_asked", F.lit(False))})
    known = known.filter(F.col("met") | ((F.col("rows") > 1) & (F.col("asked") > 0))).select(*block, "said", "asked", "by_asked", "first_id")
    # a row of these is linked to another row of its node, or to a node that it met; one of the two rows is asked about
    linked = F.col("wanted_") | (F.col("asked") > 0) | F.col("by_asked")
    row = stored(rows.drop("order").join(known, [*block, "said"]).select(id_, linked.alias("linked"), "first_id"), f"{name}-linked")
    between = pairs.select(F.col("u_first_id").alias("a"), F.col("v_first_id").alias("b"))
    # rows of a node hang together through a row asked about, of their own node or of another
    return row.filter("linked").select(id_), between.union(row.select(F.col(id_).alias("a"), F.col("first_id").alias("b")))


def _by_key(df: DataFrame, key: list[str], id_: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The same for rows with an equal key; a null in it is equal to nothing."""
    row = df.select(id_, "wanted_", *key).dropna(subset=key)
    held = _classes(row, key, id_, "wanted_").filter("rows > 1 and asked > 0")
    found = stored(row.join(held, key).select(id_, "first_id"), f"{name}-linked")
    return found.select(id_), found.select(F.col(id_).alias("a"), F.col("first_id").alias("b"))


def procurement_audit(df: DataFrame, id_: str, buyer: str, words: str, amount: str, day: str, asked: str, *, alike: int = 50, same: int = 80) -> DataFrame:
    """Every row with group_id, the least id of the rows that may be the same procurement, and why: same_amount and same_day
    (a day, and `alike` percent of the words) and same_words (`same` percent) under one buyer, same_offer (all words and the
    amount) under any. Of two linked rows one at least is asked about.

    A null or zero amount, a null day, a null buyer and a set without words match nothing. Rows that share an id are one
    member; a row of a null id has no group. Pairs of equal rows are never listed: equal sets and equal keys are classes
    whose members hang on their least id.
    """
    rows = df.select(id_, F.col(buyer).alias("buyer"), _in_order(words).alias("words"), F.when(F.col(amount) != 0, F.col(amount)).alias("amount"), F.col(day).alias("day"), F.coalesce(asked, F.lit(False)).alias("wanted_"))
    rows = rows.filter(F.col(id_).isNotNull()).withColumn("said", F.when(F.size("words") > 0, F.unhex(F.md5(F.to_json("words")))))
    rows = stored(_ordered(stored(rows, "audited"), "said").drop("words"), "coded")
    found = {
        "same_amount": _by_key(rows, ["buyer", "amount"], id_, "amount"),
        "same_day": _by_words(rows, ["buyer", "day"], id_, alike, "day"),
        "same_words": _by_words(rows, ["buyer"], id_, same, "words"),
        "same_offer": _by_key(rows, ["said", "amount"], id_, "offer"),
    }
    links, told = None, rows.select(id_, F.lit(None).alias("first"), F.lit(None).cast("string").alias("why"))
    for name, (ids, more) in found.items():
        links = more if links is None else links.union(more)
        told = told.union(ids.select(id_, F.lit(None), F.lit(name)))
    told = told.union(groups(links).select("member", "first", F.lit(None)))
    flags = [F.coalesce(F.max(F.col("why") == name), F.lit(False)).alias(name) for name in found]
    return told.groupBy(id_).agg(F.min("first").alias("first"), *flags).select(id_, F.coalesce("first", id_).alias("group_id"), *found)
