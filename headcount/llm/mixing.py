"""Interleaving sources to target weights by proportionate fair scheduling.

Each source is cut into blocks of equal size. Slots come in frames of equal length. After f frames
a source has had its exact share of their slots, rounded: shares are rounded to whole slots, but
weights never are, so that what is left over is carried on and nothing drifts. In a frame the source
has ``parts`` blocks of its own; block k of them is released at slot floor(k frame / parts) and due
by slot ceil((k + 1) frame / parts), and the released block with the earliest deadline goes first.
On one processor this meets every deadline. Frames do not depend on each other.

More sources than a frame takes are mixed in a tree: a node's slots are dealt to its entries, and
the slots of an entry that stands for a node to that node's entries, by the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headcount.llm.shared import by_size, cut, table

#: Documents of a block.
BLOCK = 32
#: Slots of a frame.
FRAME = 1000
#: Entries of a node of the tree; the root has one more, of the rows without a source or a target.
SOURCES = 200
#: Without targets, a source's weight is its number of documents to this power.
POWER = 0.5
#: Rows of a source that are ranked in one group, at least.
GROUP = 256


def shares(counts: DataFrame, targets: DataFrame | None, most: int, power: float) -> tuple[DataFrame, list[int]]:
    """``id``, ``level``, ``node``, ``name``, ``n``, ``weight`` per source, and the numbers of nodes by level from the leaves up.

    Sources at the root have the last level. The one without a name takes rows without a source and,
    with ``targets`` (source, weight), those of sources that have none; it weighs as the least of the
    others. Targets that list a source twice, none by name, or a weight that is not positive raise.
    """
    ranked = counts.where("name IS NOT NULL")
    if targets is None:
        ranked = ranked.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        wanted = cut(targets.select(F.col("source").cast("string").alias("name"), F.col("weight").cast("double").alias("weight")))
        sound = F.coalesce((F.col("weight") > 0) & (F.col("weight") < float("inf")) & F.col("name").isNotNull(), F.lit(False))
        if wanted.where(~sound).count() or wanted.groupBy("name").count().where("count > 1").count():
            raise ValueError("targets need one positive weight for each source")
        ranked = ranked.join(wanted, "name")
    named = cut(ranked)
    known = named.agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("n"), F.min("weight").alias("least")).first()
    left = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) - (known["n"] or 0)
    other = float(left) ** power if targets is None else known["least"] or 1.0
    nameless = named.sparkSession.range(1 if left else 0).select(
        F.lit(None).cast("string").alias("name"), F.lit(left).cast("long").alias("n"), F.lit(other).alias("weight")
    )
    if known["sources"] <= most:
        rows = named.select("name", "n", "weight").unionByName(nameless).select("*", F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"))
        return cut(rows.withColumn("id", F.monotonically_increasing_id())), [1]
    # The largest have an entry at the root, which one entry more shares with all the others.
    fan = max(most, 4)
    own = cut(named.orderBy(F.desc("n"), "name").limit(most - 1)).select("name")
    members = known["sources"] - (most - 1)
    nodes = [1 if members <= fan else -(-members // (fan // 2))]
    while nodes[-1] > 1:
        nodes.append(-(-nodes[-1] // fan))
    nodes.append(1)
    root = len(nodes) - 1
    first = named.join(by_size(own), "name", "left_semi").select("name", "n", "weight").unionByName(nameless)
    first = first.select("*", F.lit(root).alias("level"), F.lit(0).cast("long").alias("node"))
    rest = named.join(by_size(own), "name", "left_anti")
    rest = rest.select("name", "n", "weight", F.lit(0).alias("level"), F.pmod(F.xxhash64("name"), F.lit(nodes[0])).cast("long").alias("node"))
    return cut(first.unionByName(rest).withColumn("id", F.monotonically_increasing_id())), nodes


#: Slot by slot: of the sources whose next block is released, the one due first; ties by place. An entry's next
#: block k has a rank, deadline and place in one number, and a release; both are renewed for the entry that is picked.
SCHEDULE = """
aggregate(
  sequence(0L, frame - 1),
  named_struct(
    'k', transform(parts, x -> 0L),
    'free', transform(parts, x -> 0L),
    'rank', transform(parts, (x, i) -> ((frame + x - 1) DIV x) * size(parts) + i),
    'order', CAST(array() AS ARRAY<INT>)),
  (a, t) -> transform(
    array(CAST(array_min(zip_with(a.rank, a.free, (r, f) -> IF(f <= t, r, NULL))) % size(parts) AS INT)),
    p -> IF(p IS NULL,
      named_struct('k', a.k, 'free', a.free, 'rank', a.rank, 'order', concat(a.order, array(p))),
      named_struct(
        'k', concat(slice(a.k, 1, p), array(a.k[p] + 1), slice(a.k, p + 2, size(parts))),
        'free', concat(slice(a.free, 1, p), array((a.k[p] + 1) * frame DIV parts[p]), slice(a.free, p + 2, size(parts))),
        'rank', concat(slice(a.rank, 1, p), array((((a.k[p] + 2) * frame + parts[p] - 1) DIV parts[p]) * size(parts) + p), slice(a.rank, p + 2, size(parts))),
        'order', concat(a.order, array(p))))
  )[0],
  a -> a.order
)
"""


def schedule(packed: DataFrame, *keys: str) -> DataFrame:
    """``i``, ``k``, ``at``: the slot in the frame of entry i's k-th block of a frame, for each value of the keys.

    Slots in which no block is released have no row.
    """
    slots = packed.select(*keys, F.posexplode(F.expr(SCHEDULE)).alias("at", "i")).where("i IS NOT NULL")
    return slots.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "i").orderBy("at")) - 1)


#: Blocks of each entry in the first n slots: of what those before it leave, its share of the weights from it on.
#: Each is rounded so that no entry's count falls when n grows, and the counts add up to n.
COUNTS = """
aggregate(
  weights, named_struct('left', {n}, 'counts', CAST(array() AS ARRAY<BIGINT>)),
  (a, x) -> transform(
    array(least(a.left, CAST(floor(a.left * (x.weight / x.onward) + 0.5D) AS BIGINT))),
    c -> named_struct('left', a.left - c, 'counts', concat(a.counts, array(c)))
  )[0],
  a -> a.counts
)
"""


def timetable(entries: DataFrame, frame: int) -> DataFrame:
    """``node``, ``id``, ``block``, ``slot``, ``release``, ``deadline`` of the blocks of each node's entries.

    ``entries`` has ``node``, ``id``, ``place`` (their order), ``weight`` and ``blocks``. From the
    frame on in which an entry has no block left, its slots stay empty. Frames with the same parts
    have the same schedule, which is made once.
    """
    packed = entries.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "id", "weight", "blocks"))).alias("s"))
    # Weights from an entry on are summed from the end, so that the last entry's share is 1.
    packed = packed.withColumn("weights", F.expr("""
        reverse(aggregate(reverse(s), CAST(array() AS ARRAY<STRUCT<weight: DOUBLE, onward: DOUBLE>>), (a, x) -> concat(a, array(
          named_struct('weight', x.weight, 'onward', x.weight + coalesce(try_element_at(a, -1).onward, 0D))))))"""))
    packed = packed.withColumn("ids", F.expr("transform(s, x -> x.id)")).withColumn("blocks", F.expr("transform(s, x -> x.blocks)"))
    # Rounding puts an entry off its share by half a block for each entry at most.
    last = f"aggregate(s, 0L, (a, x) -> greatest(a, CAST(ceil((x.blocks + 2 + size(s)) * (weights[0].onward / x.weight) / {frame}) AS BIGINT)))"
    frames = packed.select("node", "ids", "weights", "blocks", F.explode(F.expr(f"sequence(0L, {last})")).alias("f"))
    frames = frames.repartition("node", "f")
    frames = frames.withColumn("base", F.expr(COUNTS.format(n=f"f * {frame}L")))
    frames = frames.withColumn("next", F.expr(COUNTS.format(n=f"(f + 1) * {frame}L")))
    frames = frames.withColumn("live", F.expr(
        "filter(transform(ids, (x, i) -> named_struct('id', x, 'base', base[i], 'parts', next[i] - base[i], 'blocks', blocks[i])), x -> x.parts > 0 AND x.base < x.blocks)"
    ))
    frames = cut(frames.where("size(live) > 0").select("node", "f", "live", F.expr("transform(live, x -> x.parts)").alias("parts")))
    turns = schedule(frames.select("parts").distinct().withColumn("frame", F.lit(frame).cast("long")), "parts")
    turns = turns.groupBy("parts").agg(F.collect_list(F.struct("i", F.col("k").cast("long").alias("k"), "at")).alias("turns"))
    rows = frames.join(turns, "parts").select("node", "f", "live", F.inline("turns")).select("node", "f", "k", "at", F.expr("live[i]").alias("x"))
    start = f"f * {frame}L"
    return rows.select(
        "node",
        "x.id",
        F.expr("x.base + k").alias("block"),
        F.expr(f"{start} + at").alias("slot"),
        F.expr(f"{start} + k * {frame}L DIV x.parts").alias("release"),
        F.expr(f"{start} + ((k + 1) * {frame}L + x.parts - 1) DIV x.parts").alias("deadline"),
        F.col("x.blocks").alias("__blocks"),
    ).where("block < __blocks").drop("__blocks")


def turns_of(sources: DataFrame, nodes: list[int], frame: int, most: int, block: int) -> DataFrame:
    """``id``, ``block``, ``slot``, ``release``, ``deadline`` of each block of each source, up to its first that is not full.

    The slots of a node below the root are the blocks of its entry one level up.
    """
    fan, root = max(most, 4), len(nodes) - 1
    place = F.struct(F.col("name").isNull().alias("last"), (-F.col("n")).alias("m"), F.col("name").alias("name"))
    leaves = sources.select("level", "node", "id", place.alias("place"), "weight", F.expr(f"n DIV {block} + 1").alias("blocks"))
    done = above = None
    for level in range(root + 1):
        entries = leaves.where(F.col("level") == level).drop("level")
        entries = cut(entries if above is None else entries.unionByName(above))
        made = cut(timetable(entries, frame))
        own = made.where("id >= 0")
        if done is None:
            done = own
        else:
            up = made.where("id < 0").select((-F.col("id") - 1).alias("node"), F.col("block").alias("__turn"), F.col("node").alias("__node"), F.col("slot").alias("__up"))
            for name, end in (("slot", 0), ("release", 0), ("deadline", 1)):
                bound = up.select("node", "__turn", (F.col("__up") + end).alias(f"__{name}"), *(["__node"] if name == "slot" else []))
                done = done.withColumn("__turn", F.col(name) - end).join(bound, ["node", "__turn"]).drop("__turn")
            lifted = [F.col("__node").alias("node"), "id", "block", *[F.col(f"__{c}").alias(c) for c in ("slot", "release", "deadline")]]
            done = done.select(*lifted).unionByName(own)
        done = cut(done)
        if level < root:
            needed = made.groupBy("node").agg(F.max("deadline").alias("blocks"))
            sums = entries.groupBy("node").agg(F.sum("weight").alias("weight"), F.sum("place.m").alias("m")).join(needed, "node")
            named = F.struct(F.lit(False).alias("last"), F.col("m"), F.col("node").cast("string").alias("name"))
            parent = F.lit(0) if level + 1 == root else F.floor(F.col("node") / fan)
            above = sums.select(parent.cast("long").alias("node"), (-F.col("node") - 1).alias("id"), named.alias("place"), "weight", "blocks")
    return done.drop("node")


def mix(
    docs: DataFrame, targets: DataFrame | None = None, key: str = "doc_id", source: str = "source", block: int = BLOCK,
    frame: int = FRAME, most: int = SOURCES, power: float = POWER,
) -> DataFrame:
    """docs with ``block`` (number within its source), ``release``, ``deadline``, ``slot``, ``place`` and ``mixed``.

    ``slot`` is the block's turn and ``place`` the document's within it. Every row gets one. When a
    source has run out, its slots stay empty and the others keep theirs; ``mixed`` tells the rows
    before the first slot that lacks a full block, in which the shares hold. Within a source the
    order is that of MD5 digests of the ids; rows that repeat an id follow each other.

    Ranks come from groups of digests next to each other, whose size grows with the root of the
    source's, and running sums over the groups: no task holds a source.
    """
    placed, horizon = _placed(docs, targets, key, source, block, frame, most, power)
    made = {c: F.col(f"__{c}") for c in ("block", "release", "deadline", "slot", "place")}
    made["mixed"] = F.col("__slot") < F.lit(horizon)
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in made], *[value.alias(c) for c, value in made.items()]
    )


def _placed(
    docs: DataFrame, targets: DataFrame | None = None, key: str = "doc_id", source: str = "source", block: int = BLOCK,
    frame: int = FRAME, most: int = SOURCES, power: float = POWER, ranges: int = 0,
) -> tuple[DataFrame, int]:
    """docs with columns named ``__...`` for the block, its slot and the place in it; the first slot that lacks a full block.

    With ``ranges``, ``__range`` numbers about as many ranges of slots with about as many rows each.
    """
    names = docs.columns
    counts = cut(docs.groupBy(F.col(f"`{source}`").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")))
    sources, nodes = shares(counts, targets, most, power)
    turns = cut(turns_of(sources, nodes, frame, most, block))
    # The first slot that lacks a full block of some source.
    full = sources.select("id", F.expr(f"n DIV {block}").alias("block"))
    horizon = turns.join(full, ["id", "block"]).agg(F.min("slot").alias("h")).first()["h"]
    told = ["block", "slot", "release", "deadline"]
    if ranges:
        turns = cut(turns.join(by_size(_ranges(turns, sources, block, ranges)), "slot"))
        told.append("range")
    own = sources.select("name", F.col("id").alias("__i"), F.ceil(F.col("n") / F.greatest(F.lit(GROUP), F.sqrt("n"))).cast("long").alias("__groups"))
    nameless = own.where("name IS NULL").first()
    own = cut(own.where("name IS NOT NULL").withColumnRenamed("name", "__own"))
    digest = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    rest = _rest(docs, names, key)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{source}`").cast("string").alias("__name"), digest.alias("__md5"))
    rows = rows.join(by_size(own), F.col("__name") == F.col("__own"), "left")
    if nameless:
        rows = rows.withColumns({c: F.coalesce(c, F.lit(nameless[c])) for c in ("__i", "__groups")})
    rows = rows.withColumn(
        "__group", F.expr("CAST(conv(substr(__md5, 1, 8), 16, 10) AS BIGINT) * __groups DIV 4294967296")
    )
    sizes = rows.groupBy("__i", "__group").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__i").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.select("__i", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    within = Window.partitionBy("__i", "__group").orderBy("__md5", F.col(f"`{key}`"), *_rest(docs, names, key))
    ranked = rows.withColumn("__row", F.row_number().over(within) - 1).join(starts, ["__i", "__group"])
    ranked = ranked.withColumn("__rank", F.col("__start") + F.col("__row"))
    ranked = ranked.withColumn("__block", F.expr(f"__rank DIV {block}"))
    slots = turns.select(F.col("id").alias("__i"), *[F.col(c).alias(f"__{c}") for c in told])
    placed = ranked.join(by_size(slots), ["__i", "__block"])
    return placed.withColumn("__place", F.expr(f"CAST(__rank % {block} AS INT)")), horizon or 0


def _ranges(turns: DataFrame, sources: DataFrame, block: int, ranges: int) -> DataFrame:
    """``slot``, ``range`` of the slots with rows. Their numbers are dealt out, one for each row, so that no text is read for it."""
    rows = turns.join(by_size(sources.select("id", "n")), "id").select("slot", F.expr(f"least({block}, n - block * {block})").alias("n"))
    each = rows.where("n > 0").select("slot", F.explode(F.expr("sequence(1L, n)"))).select("slot")
    return cut(each.repartitionByRange(ranges, "slot").select("slot", F.spark_partition_id().alias("range")).distinct())


def _rest(docs: DataFrame, names: list[str], key: str) -> list:
    """A digest of the other columns, which settles the order of rows that repeat an id."""
    plain = [F.col(f"`{c}`") for c in names if c != key and not docs.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    return [F.xxhash64(*plain)] if plain else []


def in_order(docs: DataFrame, **options) -> DataFrame:
    """docs in the order of their slots and places: ranges of it go to partitions, each sorted.

    The ranges come from the turns, so the rows are ranked once and then sent to their ranges.
    """
    order = ["__slot", "__place"]
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, _ = _placed(docs, ranges=wide, **options)
    rows = placed.select(*[F.col(f"`{c}`") for c in docs.columns], "__range", *order)
    return rows.repartitionById(wide, "__range").sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


ORACLE_OP9 = f"""
WITH RECURSIVE counts AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY source),
named AS (
  SELECT name, n, pow(CAST(n AS DOUBLE), {POWER}) AS weight FROM counts WHERE name IS NOT NULL ORDER BY n DESC, name LIMIT {SOURCES}
),
pooled AS (SELECT (SELECT sum(n) FROM counts) - (SELECT coalesce(sum(n), 0) FROM named) AS n),
both_ AS (
  SELECT * FROM named
  UNION ALL SELECT NULL, CAST(n AS BIGINT), pow(CAST(n AS DOUBLE), {POWER}) FROM pooled WHERE n > 0
),
shares AS (
  SELECT CAST(row_number() OVER (ORDER BY name IS NULL, n DESC, name) AS BIGINT) AS i, name, n,
         CAST(greatest(1, round({FRAME} * weight / sum(weight) OVER ())) AS BIGINT) AS parts FROM both_
),
packed AS (SELECT list(parts ORDER BY i) AS every, CAST(sum(parts) AS BIGINT) AS frame FROM shares),
slots AS (
  SELECT CAST(-1 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS pick, list_transform(every, lambda p: CAST(0 AS BIGINT)) AS nxt FROM packed
  UNION ALL
  SELECT turn, pick, list_transform(nxt, lambda j, i: j + CASE WHEN i = pick THEN 1 ELSE 0 END)
  FROM (
    SELECT turn + 1 AS turn, nxt, list_min(list_filter(
             list_transform(nxt, lambda j, i: CASE WHEN j * frame // every[i] <= turn + 1
               THEN (((j + 1) * frame + every[i] - 1) // every[i]) * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS pick
    FROM slots, packed WHERE turn + 1 < frame
  )
),
turns AS (SELECT pick AS i, turn, row_number() OVER (PARTITION BY pick ORDER BY turn) - 1 AS k FROM slots WHERE turn >= 0),
ranked AS (
  SELECT doc_id, source, coalesce(s.i, (SELECT max(i) FROM shares)) AS i, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents LEFT JOIN shares s ON source = s.name
),
blocks AS (
  SELECT doc_id, source, i, row_number() OVER (PARTITION BY i ORDER BY h, doc_id) - 1 AS r FROM ranked
),
horizon AS (
  SELECT min(((n // {BLOCK}) // parts) * frame + turn) AS h
  FROM shares s CROSS JOIN packed p JOIN turns t ON t.i = s.i AND t.k = (n // {BLOCK}) % s.parts
)
SELECT doc_id, source, r // {BLOCK} AS block, (r // {BLOCK}) * frame // s.parts AS release,
       ((r // {BLOCK} + 1) * frame + s.parts - 1) // s.parts AS deadline,
       ((r // {BLOCK}) // s.parts) * frame + turn AS slot, CAST(r % {BLOCK} AS INTEGER) AS place,
       ((r // {BLOCK}) // s.parts) * frame + turn < (SELECT h FROM horizon) AS mixed
FROM blocks b JOIN shares s ON s.i = b.i CROSS JOIN packed p JOIN turns t ON t.i = b.i AND t.k = (r // {BLOCK}) % s.parts
"""
