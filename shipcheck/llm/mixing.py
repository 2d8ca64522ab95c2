"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

In the fluid schedule every source goes on by its weight w, and when one runs out, the others in proportion: at virtual
time v a source has min(n, w v) of its n blocks and all have T(v) together.  Block j is released at floor(T(j / w)) and
due at ceil(T((j + 1) / w)); earliest deadline first meets every deadline, so that after each slot a source holds the floor
or the ceiling of its fluid share: less than one block of deviation, for any number of sources.  Weights are whole numbers
here, so releases and deadlines are exact.

The schedule is made in frames, all at once.  Under earliest deadline first, how many blocks up to a deadline are done at a
slot depends on the past only through the sum, once every window open at the start is closed.  So a frame as long as
the longest window begins with any state of the fluid schedule one frame earlier, and arrives at its own first slot with
the state of the one schedule from slot 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, materialise, shuffle_partitions

#: Least slots of a frame, and documents of a block.
CYCLE, BLOCK = 400, 16
#: A source's least share of the slots is 1 in so many, which bounds windows and so the frames, each of which one task holds.
LONGEST = 1 << 14


def source_weights(sizes: DataFrame, targets: dict[str, float] | None, alpha: float, cycle: int | None) -> DataFrame:
    """_src, n_docs, w: target weights (given, or n_docs ** alpha), exact or, with `cycle`, in whole slots of a cycle, one at
    least.  Sources without a weight share one slot in CYCLE."""
    if targets:
        pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("_src")), F.lit(0.0))
    else:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(alpha))
    every = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("_w", weight).withColumn("_sum", F.sum("_w").over(every)).withColumn("_none", F.sum((F.col("_w") <= 0).cast("int")).over(every))
    if cycle:
        w = F.greatest(F.lit(1.0), F.round(F.col("_w") * cycle / F.greatest("_sum", F.lit(1e-300))))
    else:
        w = F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.when(F.col("_sum") > 0, F.col("_sum") / CYCLE).otherwise(1.0) / F.greatest("_none", F.lit(1)))
    return s.select("_src", "n_docs", w.alias("w"))


def fluid(weights: DataFrame, block: int, cycle: int | None) -> DataFrame:
    """One row (none without blocks): _all, the sources by the virtual time of their end, with blocks n and whole weights w;
    _lines, of which T(v) is the least: n ended blocks and live weight w, which hold from slot lo to hi; _total, _h slots of a frame.

    Without `cycle` the weights are in units so small that products with block numbers just fit 64 bits: with N blocks they
    move a share by less than N * N / 2 ** 59 blocks in all."""
    p = weights.select("_src", "w", F.ceil(F.col("n_docs") / block).alias("_n")).groupBy().agg(
        F.collect_list(F.struct(F.col("_src").alias("src"), F.col("_n").alias("n"), "w")).alias("_given"), F.sum("_n").alias("_total"), F.sum("w").alias("_sum"), F.count(F.lit(1)).alias("_count")
    ).where("_total > 0")
    unit = f"shiftleft(1L, cast(least(46, 60 - ceil(log2(_total + 1)) - ceil(log2(1 + _count / {LONGEST}))) as int))"
    whole = "cast(x.w as bigint)" if cycle else f"greatest(cast(round(x.w / _sum * _unit) as bigint), _unit div {LONGEST})"
    p = p.withColumn("_unit", F.expr(unit)).withColumn("_whole", F.expr(f"transform(_given, x -> named_struct('src', x.src, 'n', x.n, 'w', {whole}))"))
    p = p.withColumn("_all", F.expr("transform(sort_array(transform(_whole, x -> named_struct('end', x.n / x.w, 'x', x))), y -> named_struct('end', y.end, 'src', y.x.src, 'n', y.x.n, 'w', y.x.w))"))
    p = p.withColumn("_live", F.expr("aggregate(_all, 0L, (a, x) -> a + x.w)"))
    p = p.withColumn("_lines", F.expr("""aggregate(_all,
        named_struct('n', 0L, 'w', _live, 'end', -1D, 'hi', 0L, 'out', cast(array() as array<struct<n: bigint, w: bigint, lo: bigint, hi: bigint>>)),
        (a, x) -> transform(array(a.n + (a.w * x.n + x.w - 1) div x.w), hi -> named_struct('n', a.n + x.n, 'w', a.w - x.w, 'end', x.end, 'hi', if(x.end > a.end, hi, a.hi),
            'out', if(x.end > a.end, concat(a.out, array(named_struct('n', a.n, 'w', a.w, 'lo', a.hi, 'hi', hi))), a.out)))[0],
        a -> a.out)"""))  # fmt: skip
    return p.select("_all", "_lines", "_total", F.expr(f"greatest({CYCLE}L, _live div array_min(transform(_all, x -> x.w)) + 2L)").alias("_h"))


def released(flow: DataFrame, partitions: int) -> DataFrame:
    """The blocks that each frame _f has to do with: _j of source _src with release and deadline, from the frame before on (_s0);
    _t0 and _t1 are its own slots.  A source that has begun a block at _s0 has done it or not, so that _s0 are done together."""
    f = flow.select("*", F.explode(F.expr("sequence(0L, (_total - 1) div _h)")).alias("_f")).repartition(partitions, "_f")
    f = f.select("*", F.expr("_f * _h").alias("_t0"), F.expr("least((_f + 1) * _h, _total)").alias("_t1"), F.expr("greatest((_f - 1) * _h, 0L)").alias("_s0"))
    f = f.withColumn("_near", F.expr("filter(_lines, g -> g.hi >= _s0 - _h - 1 and g.lo <= _t1 + _h + 1)"))
    share = "least(x.n, greatest(0L, array_max(transform(_near, g -> (x.w * ({t} - g.n) + {up}) div g.w))))"
    at = f"'low', {share.format(t='_s0', up='0')}, 'high', {share.format(t='_s0', up='g.w - 1')}, 'to', {share.format(t='_t1', up='g.w - 1')}"
    f = f.withColumn("_at", F.expr(f"transform(_all, (x, i) -> named_struct('i', i, 'src', x.src, 'w', x.w, {at}))"))
    f = f.withColumn("_more", F.expr("cast(_s0 - aggregate(_at, 0L, (a, x) -> a + x.low) as int)"))
    last = "if(_more > 0, get(filter(_at, x -> x.high > x.low), _more - 1).i, -1)"  # bound, as a lambda's body is evaluated for each element
    f = f.withColumn("_from", F.expr(f"transform(array({last}), l -> filter(transform(_at, x -> named_struct('x', x, 'k', if(x.high > x.low and x.i <= l, x.high, x.low))), y -> y.k < y.x.to))[0]"))
    # explode_outer: below explode, Spark puts a filter over the exploded array, which evaluates the whole chain once more
    f = f.select("_f", "_s0", "_t0", "_t1", "_near", F.explode_outer("_from").alias("_y")).where("_y is not null")
    f = f.select("_f", "_s0", "_t0", "_t1", "_near", F.col("_y.x.i").alias("_i"), F.col("_y.x.src").alias("_src"), F.col("_y.x.w").alias("_w"), F.explode_outer(F.expr("sequence(_y.k, _y.x.to - 1)")).alias("_j"))
    release, due = F.expr("array_min(transform(_near, g -> g.n + (g.w * _j) div _w))"), F.expr("array_min(transform(_near, g -> g.n + (g.w * (_j + 1) + _w - 1) div _w))")
    return f.select("_f", "_s0", "_t0", "_t1", "_i", "_src", "_j", release.alias("release"), due.alias("deadline"))


def block_slots(blocks: DataFrame) -> DataFrame:
    """A row for each block with its slot.  Between two releases the waiting blocks go by deadline, so the fold is over releases."""
    b = blocks.withColumn("_b", F.struct(F.col("deadline").alias("due"), F.col("_i").alias("i"), F.col("_j").alias("j"), "release", F.col("_src").alias("src")))
    e = b.groupBy("_f", "_t0", "_t1", F.greatest("release", "_s0").alias("at")).agg(F.collect_list("_b").alias("new"))
    e = e.groupBy("_f", "_t0", "_t1").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("_e"))
    e = e.withColumn("_steps", F.expr("transform(_e, (x, m) -> named_struct('at', x.at, 'to', coalesce(get(_e, m + 1).at, _t1), 'new', x.new))"))
    job = "struct<due: bigint, i: int, j: bigint, release: bigint, src: string>"
    e = e.withColumn("_done", F.expr(f"""aggregate(_steps,
        named_struct('wait', cast(array() as array<{job}>), 'out', cast(array() as array<struct<at: bigint, go: array<{job}>>>)),
        (a, x) -> transform(array(sort_array(concat(a.wait, x.new))), q -> named_struct(
            'wait', slice(q, cast(x.to - x.at as int) + 1, size(q)),
            'out', if(x.to <= _t0, a.out, concat(a.out, array(named_struct('at', x.at, 'go', slice(q, 1, cast(x.to - x.at as int))))))))[0],
        a -> a.out)"""))  # fmt: skip
    s = e.select("_t0", F.explode_outer("_done").alias("_d")).select("_t0", F.col("_d.at").alias("_at"), F.posexplode_outer("_d.go").alias("_k", "_b"))
    s = s.withColumn("slot", F.col("_at") + F.col("_k")).where("slot >= _t0")
    return s.select(F.col("_b.src").alias("_psrc"), F.col("_b.j").alias("_pb"), F.col("_b.release").alias("release"), F.col("_b.due").alias("deadline"), "slot")


def mix(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, block: int = BLOCK, cycle: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs with its place in the mix.

    targets: weight by source (sources not named share one slot in CYCLE); None: sizes to the power
    alpha; a source gets one slot in LONGEST at least.  cycle: None schedules these weights; a number rounds
    them to whole slots of a cycle of that length.  When a source has no blocks left, the others go on in
    proportion.  At every slot a source is less than one block off its fluid share.  The sources, not the
    blocks, are in one row, and a frame (max(CYCLE, 1 / least share) slots) in one task at a time.
    A null source is a source of its own.  Rows of one source are ordered by a hash of their id,
    so that a hot source is cut evenly: one range exchange of ids, no group in one task; blocks
    find their slots by a join on (source, block).
    Columns: doc_id, source, block (of the source), release, deadline, slot (all in blocks,
    global), offset (in the block), and `keep`."""
    keep = keep or []
    slim = docs.select("doc_id", "source", F.xxhash64("doc_id").alias("_mix"), *keep)
    ranked = global_rank(slim, ["_mix", "doc_id"], ["source"], name="mix")
    sizes = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs")).withColumnRenamed("source", "_src")
    flow = fluid(source_weights(sizes, targets, alpha, cycle), block, cycle)
    plan = materialise(block_slots(released(flow, shuffle_partitions(docs.sparkSession))), "mixplan")
    r = ranked.withColumn("_b", F.expr(f"_rank div {block}L"))
    r = r.join(plan, F.col("source").eqNullSafe(F.col("_psrc")) & (F.col("_b") == F.col("_pb")))
    return r.select("doc_id", "source", F.col("_b").alias("block"), "release", "deadline", "slot", F.expr(f"_rank % {block}L").alias("offset"), *keep)


def in_order(docs: DataFrame, **how) -> DataFrame:
    """docs, whole, written out in the order of the mix (by slot, then offset) under one range
    exchange; columns as they were.  Rows that share an id stay together."""
    places = mix(docs, **how).groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct("slot", "offset")).alias("_at"))
    placed = docs.join(places, F.col("doc_id").eqNullSafe(F.col("_id")))
    return placed.repartitionByRange(shuffle_partitions(docs.sparkSession), "_at").sortWithinPartitions("_at").select(*docs.columns)
