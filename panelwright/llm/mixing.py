"""Mixing sources to target weights; DataFrame functions only.

Documents of a source fall by a hash into blocks. A source's target is met by
whole passes over its blocks and a last pass over the first blocks in permuted
order. Of the block that the target falls into, documents are taken whole, the
largest that still fits first. A block taken once in a pass is one item. A tree
splits the items among the output shards: each node draws how many of each
source's go left, one hypergeometric number a source given the ones before it;
the exact quotas of the leaves then cut the permuted items of each source into
disjoint runs, one a shard. Within a shard documents are shuffled by a hash.

No step needs all blocks of a source in one task: the order of blocks is
counted by bands of some thousand blocks. Texts are shuffled twice by ``draw``:
to their blocks and to their shards.

Defined cases: a null or empty text has size 0 and is never drawn; a very long
text is counted and drawn whole, so a source misses its target by less than the
smallest document of a block that was not taken; null is a source like any
other, the last; repeated rows are documents of their own; of documents that
tie (equal size in the last block) those with the smaller hash go first, and
equal rows are interchangeable; rows that are equal in doc_id and text share a
block; an empty table gives no row; all draws come from hashes, so reruns
agree. Columns other than doc_id, text and source are carried along by
``draw``, even where their names are those used here.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, few

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Blocks of a source that are put in order together.
BAND = 4096
#: Words of a shard that go to one task.
PIECE_WORDS = 1 << 21


def hash32(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of the parts joined by colons; null is 'null'."""
    said = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *said)), 1, 8), 16, 10).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def source_targets(sources: DataFrame, total: int, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> rank, weight, target.

    The resharing ends where every source has the smaller of its cap and its
    weight times one level. Sources in order of cap per weight reach their caps
    first, so the level follows from running sums: the first one that its own
    source can stand, which is the largest such.
    """
    ranked = sources.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") - 1) % len(WEIGHTS) + 1))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    goal = F.lit(share * total)
    everywhere = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (goal - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (
        F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    )
    found = ranked.withColumn("level", level).withColumn(
        "level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everywhere)
    )
    return found.select(
        "source",
        "source_size",
        "rank",
        F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def _bind(value: str, name: str, body: str) -> str:
    """SQL: body, in which name stands for value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def log_factorial(n: str) -> str:
    """SQL: ln n! of a double, by Stirling's series from 10 up."""
    small = ", ".join(f"{math.lgamma(k + 1)!r}D" for k in range(10))
    series = f"({n} + 0.5D) * ln({n}) - {n} + {0.5 * math.log(2 * math.pi)!r}D + 1 / (12 * {n}) - 1 / (360 * pow({n}, 3)) + 1 / (1260 * pow({n}, 5))"
    return f"if({n} < 10, element_at(array({small}), 1 + cast({n} as int)), {series})"


def hypergeometric(whole: str, marked: str, drawn: str, u: str) -> str:
    """SQL: how many of ``drawn`` things out of ``whole`` are among the ``marked``: the quantile of u, counted from the mode outwards.

    The steps are some standard deviations, twelve at most, so they grow with the
    square root of the numbers; what lies beyond has a chance below 1e-30.
    """
    terms = [("+", "c"), ("-", "m"), ("-", "c - s.m"), ("+", "n - s.c"), ("-", "w - s.m"), ("-", "n - s.c - s.w + s.m"), ("-", "n"), ("+", "w"), ("+", "n - s.w")]
    # The logarithm of the mode's chance.
    chance = f"aggregate(transform(array({', '.join(f'cast(s.{x} as double)' for _, x in terms)}), x -> {log_factorial('x')}), " + (
        f"cast(array() as array<double>), (l, x) -> array_append(l, x), l -> {' '.join(f'{sign} l[{i}]' for i, (sign, _) in enumerate(terms))})"
    )
    # One more value above and one more below the mode: their chances follow from the ones before.
    up = "if(s.m + j <= s.high, a.up * (s.c - s.m - j + 1) * (s.w - s.m - j + 1) / ((s.m + j) * (s.n - s.c - s.w + s.m + j)), 0D)"
    down = "if(s.m - j >= s.low, a.down * (s.m - j + 1) * (s.n - s.c - s.w + s.m - j + 1) / ((s.c - s.m + j) * (s.w - s.m + j)), 0D)"
    got = "if(a.u < 0, a.got, if(a.u < b.up, s.m + j, if(a.u < b.up + b.down, s.m - j, a.got)))"
    step = _bind(
        f"named_struct('up', {up}, 'down', {down})", "b", f"named_struct('u', a.u - b.up - b.down, 'up', b.up, 'down', b.down, 'got', {got})"
    )
    walk = lambda first, last, start: f"aggregate(if({last} >= {first}, sequence({first}, {last}), cast(array() as array<bigint>)), {start}, (a, j) -> {step})"
    start = _bind(f"exp({chance})", "p", "named_struct('u', s.u - p, 'up', p, 'down', p, 'got', s.m)")
    # Three deviations end nearly every walk; the rest is walked where they do not.
    near = _bind(walk("1L", "r.near", start), "z", f"if(z.u < 0, z.got, {walk('r.near + 1', 'r.reach', 'z')}.got)")
    reach = _bind(
        "named_struct('far', greatest(s.m - s.low, s.high - s.m), 'spread', sqrt(s.w * (s.c / s.n) * (1 - s.c / s.n) * (s.n - s.w) / greatest(s.n - 1, 1)))",
        "t", "named_struct('reach', least(t.far, ceil(12 * t.spread) + 20), 'near', least(t.far, ceil(3 * t.spread) + 8))",
    )
    mode = "least(y.high, greatest(y.low, cast(floor((y.w + 1D) * (y.c + 1D) / (y.n + 2D)) as bigint)))"
    numbers = "'n', cast(y.n as double), 'c', cast(y.c as double), 'w', cast(y.w as double), 'u', y.u, 'low', y.low, 'high', y.high"
    bounds = f"named_struct('n', {whole}, 'c', {marked}, 'w', {drawn}, 'u', {u}, 'low', greatest(0L, {drawn} - ({whole} - {marked})), 'high', least({marked}, {drawn}))"
    return _bind(bounds, "y", f"if(y.low >= y.high, y.low, {_bind(f'named_struct({numbers}, {chr(39)}m{chr(39)}, {mode})', 's', _bind(reach, 'r', near))})")


def _split(counts: str, node: str, seed: int) -> str:
    """SQL: how many items of each source go to the left child: half of all, drawn without replacement."""
    u = f"pmod(xxhash64({seed}, {node}, e.i), {1 << 52}L) / {float(1 << 52)!r}D"
    source = _bind(
        hypergeometric("acc.left", "e.n", "acc.want", u),
        "took", "named_struct('left', acc.left - e.n, 'want', acc.want - took, 'got', array_append(acc.got, took))",
    )
    # Sources by 64, so that long lists of them are not copied for each one.
    some = f"aggregate(slice(numbered, 64 * k + 1, 64), named_struct('left', all.left, 'want', all.want, 'got', cast(array() as array<bigint>)), (acc, e) -> {source})"
    chunk = _bind(some, "done", "named_struct('left', done.left, 'want', done.want, 'got', array_append(all.got, done.got))")
    total = f"aggregate({counts}, 0L, (a, c) -> a + c)"
    start = _bind(total, "t", "named_struct('left', t, 'want', cast(floor(t / 2) as bigint), 'got', cast(array() as array<array<bigint>>))")
    each = f"aggregate(sequence(0, cast(floor((size(numbered) - 1) / 64) as int)), {start}, (all, k) -> {chunk}, all -> flatten(all.got))"
    return _bind(f"transform({counts}, (c, i) -> named_struct('n', c, 'i', i))", "numbered", each)


def shard_quotas(quotas: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """rank, items -> shard, rank, before, quota: a run of each source's permuted items for each of 2**levels shards."""
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", "items"))).alias("q")).filter(F.size("q") > 0).select(
        F.lit(1).cast("long").alias("node"),
        F.col("q.rank").alias("ranks"),
        F.col("q.items").alias("counts"),
    )
    for _ in range(levels):
        children = "array(named_struct('node', node * 2, 'counts', took), named_struct('node', node * 2 + 1, 'counts', zip_with(counts, took, (c, x) -> c - x)))"
        nodes = nodes.select("ranks", F.explode(F.expr(_bind(_split("counts", "node", seed), "took", children))).alias("child"))
        nodes = nodes.select("child.node", "ranks", "child.counts")
    leaves = nodes.select(
        (F.col("node") - (1 << levels)).cast("int").alias("shard"),
        F.explode(F.arrays_zip(F.col("ranks").alias("rank"), F.col("counts").alias("quota"))).alias("x"),
    ).select("shard", "x.rank", "x.quota")
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("before", F.coalesce(F.sum("quota").over(before), F.lit(0)))


def _keys(docs: DataFrame, seed: int) -> list[Column]:
    """doc_id, source, its key (never null), size, the text's key and the document's hash."""
    text_key = F.md5(docs["text"])
    return [
        docs["doc_id"].alias("doc_id"),
        docs["source"].alias("source"),
        F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        text_key.alias("k"),
        hash32(F.lit(seed), docs["doc_id"], text_key).alias("h"),
    ]


def _sources(sized: DataFrame, block_words: int, share: float, most: float) -> DataFrame:
    """A row a source: its key, size, rank, target, number of blocks, whole passes and the words of the last one."""
    total = sized.agg(F.sum("size")).first()[0] or 0
    sources = sized.groupBy("source", "src").agg(F.sum("size").alias("source_size"))
    found = source_targets(sources.select("source", "source_size"), total, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    return found.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"),
        "source_size", "rank", "target",
        F.greatest(F.lit(1).cast("long"), F.floor(F.col("source_size") / block_words)).alias("n_blocks"),
        passes.alias("passes"),
        (F.round("target").cast("long") - passes * F.col("source_size")).alias("rest"),
    )


def _in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    own = sources.select("src", "source_size", "target", "n_blocks")
    return rows.join(own, "src").withColumn("block", F.pmod("h", "n_blocks"))


def _placed(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """A row a block that has words: its place among those of its source in permuted order, and the words ahead of it."""
    blocks = _in_blocks(sized, sources).groupBy("src", "block", "n_blocks").agg(F.sum("size").alias("words")).filter("words > 0")
    bands = 1 + F.floor(F.col("n_blocks") / BAND)
    blocks = blocks.withColumn("turn", hash32(F.lit(seed), F.col("src"), F.col("block")))
    blocks = blocks.withColumn("band", F.shiftright(F.col("turn") * bands, 32))
    within = Window.partitionBy("src", "band").orderBy("turn", "block")
    earlier = Window.partitionBy("src").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("src", "band").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    sums = sums.select(
        "src", "band", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0")
    )
    run = F.coalesce(F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = blocks.withColumns({"place": F.row_number().over(within) - 1, "run": run}).join(sums, ["src", "band"])
    return ordered.join(sources.select("src", "rank", "passes", "rest"), "src").select(
        "src", "block", "rank", "passes", "rest", "words", (F.col("n0") + F.col("place")).alias("place"), (F.col("w0") + F.col("run")).alias("ahead")
    )


def _last_fits(sized: DataFrame, sources: DataFrame, placed: DataFrame) -> DataFrame:
    """src, block, fits: of the block that a source's target falls into, how many documents of each size are taken."""
    edge = placed.filter("ahead < rest and ahead + words > rest").select("src", "block", (F.col("rest") - F.col("ahead")).alias("left"))
    sizes = _in_blocks(sized, sources).filter("size > 0").join(edge, ["src", "block"])
    # A block has few different sizes: with W words, less than the root of 2 W.
    sizes = sizes.groupBy("src", "block", "left", "size").agg(F.count("*").alias("n"))
    listed = sizes.groupBy("src", "block", "left").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("all"))
    empty = F.expr("cast(array() as array<struct<size:bigint,n:bigint>>)")

    def take(acc: Column, x: Column) -> Column:
        n = F.least(x["n"], F.floor(acc["left"] / x["size"]))
        return _let(
            n,
            lambda k: F.struct(
                (acc["left"] - k * x["size"]).alias("left"), F.concat(acc["fits"], F.array(F.struct(x["size"].alias("size"), k.alias("n")))).alias("fits")
            ),
        )

    fits = F.aggregate("all", F.struct(F.col("left").cast("long").alias("left"), empty.alias("fits")), take, lambda a: F.map_from_entries(a["fits"]))
    return listed.select("src", "block", fits.alias("fits"))


def _deals(sized: DataFrame, sources: DataFrame, seed: int, levels: int) -> DataFrame:
    """A row a block that is drawn: the (pass, shard) of each time, how many passes are whole, and what fits of the last one."""
    placed = cut(few(_placed(sized, sources, seed)), "placed")
    counts = placed.groupBy("src", "rank", "passes").agg(F.count("*").alias("blocks"), F.count(F.when(F.col("ahead") < F.col("rest"), 1)).alias("more"))
    quotas = shard_quotas(counts.select("rank", (F.col("passes") * F.col("blocks") + F.col("more")).alias("items")), levels, seed)
    ends = quotas.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("shard", (F.col("before") + F.col("quota")).alias("end")))).alias("runs"))
    runs = cut(counts.join(ends, "rank").select("src", "blocks", F.col("runs.end").alias("ends")).coalesce(1), "runs")
    times = F.col("passes") + F.when(F.col("ahead") < F.col("rest"), 1).otherwise(0)
    # Items of a source are numbered pass by pass, each in the order of blocks.
    number = lambda t: (t - 1) * F.col("blocks") + F.col("place")
    shard = lambda t: F.size(F.filter("ends", lambda e: e <= number(t))).alias("shard")
    dealt = F.transform(F.sequence(F.lit(1).cast("long"), times), lambda t: F.struct(t.alias("pass"), shard(t)))
    whole = F.when(F.col("ahead") + F.col("words") <= F.col("rest"), times).otherwise(F.col("passes"))
    drawn = placed.join(runs, "src").filter(times > 0).select("src", "block", whole.alias("whole"), dealt.alias("dealt"))
    return drawn.join(_last_fits(sized, sources, placed), ["src", "block"], "left")


def _dealt(rows: DataFrame, sized: DataFrame, seed: int, block_words: int, levels: int, share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """rows with source_size, target and draws, the (pass, shard) of each time that a document is taken; and the table of sources."""
    sources = cut(_sources(sized, block_words, share, most).coalesce(1), "sources")
    deals = _deals(sized, sources, seed, levels)
    nth = F.row_number().over(Window.partitionBy("src", "block", "size").orderBy("h", "doc_id", "k"))
    # Dealt by block, which serves the numbering and the join.
    numbered = _in_blocks(rows, sources).repartition("src", "block").withColumn("nth", nth)
    taken = F.filter("dealt", lambda x: (x["pass"] <= F.col("whole")) | (F.col("nth") <= F.coalesce(F.element_at("fits", F.col("size")), F.lit(0))))
    draws = F.when((F.col("size") > 0) & F.col("dealt").isNotNull(), taken).otherwise(F.expr("cast(array() as array<struct<pass:bigint,shard:int>>)"))
    return numbered.join(deals, ["src", "block"], "left").withColumn("draws", draws).drop("whole", "dealt", "fits", "nth", "block", "n_blocks"), sources


def plan_mix(
    docs: DataFrame, seed: int = 0, block_words: int = 1 << 16, levels: int = 3, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target and draws, the (pass, shard) of each time that it is taken."""
    sized = cut(few(docs.select(*_keys(docs, seed))), "sizes")
    found, _ = _dealt(sized, sized, seed, block_words, levels, share, most)
    return found.select("doc_id", "source", "size", "source_size", "target", "draws")


def draw(docs: DataFrame, seed: int = 0, block_words: int = 1 << 16, levels: int = 3, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: shard, place, taken (words), pass and the document's columns, once a draw.

    Columns that clash with the first four get the prefix ``doc_``. Every
    document is drawn whole. Rows of a shard are in the order of a hash within
    each of its files; a shard has as many of these as its words ask for.
    """
    names = docs.columns
    keys = _keys(docs, seed)
    sized = cut(few(docs.select(*keys)), "sizes")
    rows = docs.select(*keys, *[docs[f"`{c}`"].alias(f"_{i}") for i, c in enumerate(names)])
    found, sources = _dealt(rows, sized, seed, block_words, levels, share, most)
    words = sources.agg(F.sum(F.least(F.col("target"), 2 * F.col("source_size")))).first()[0] or 0
    pieces = max(1, math.ceil(words / (1 << levels) / PIECE_WORDS))
    drawn = found.select("size", "doc_id", "k", *[f"_{i}" for i in range(len(names))], F.explode("draws").alias("x"))
    return (
        drawn.select(
            F.col("x.shard").alias("shard"),
            F.xxhash64(F.lit(seed), "x.pass", "doc_id", "k").alias("place"),
            F.col("size").alias("taken"),
            F.col("x.pass").alias("pass"),
            *[F.col(f"_{i}").alias(f"doc_{c}" if c in ("shard", "place", "taken", "pass") else c) for i, c in enumerate(names)],
        )
        .repartition("shard", F.pmod("place", F.lit(pieces)))
        .sortWithinPartitions("shard", "place")
    )
