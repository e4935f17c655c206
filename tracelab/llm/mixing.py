"""Mixing sources to target weights: temperature mixing, realised by budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, written

#: Halvings of the exponent's interval; LEVELS of them are worked out in one pass over the sources.
HALVINGS, LEVELS = 49, 7
#: Exponents that are tried to find an interval: 0 and the powers of two up to this one.
MOST = 1024


def mixture(shares: DataFrame, budget: float | None, exponents: list[float]) -> DataFrame:
    """Per exponent: entropy (nats) of the weights share ** exponent, normalised, and the most repetitions of a source. Without
    a budget it is the least that uses every source whole.

    The column relative is the share of the largest: so large exponents don't underflow to no weight at all.
    """
    grid = shares.withColumn("a", F.explode(F.lit(exponents))).withColumn("lp", F.col("a") * F.log("relative")).withColumn("p", F.exp("lp"))
    sums = grid.groupBy("a").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.col("lp")).alias("plp"), F.max(F.col("p") / F.col("tokens")).alias("most"), F.min(F.col("p") / F.col("tokens")).alias("least"))
    repeats = F.col("most") / F.col("least") if budget is None else F.lit(float(budget)) * F.col("most") / F.col("z")
    return sums.select("a", (F.log("z") - F.col("plp") / F.col("z")).alias("entropy"), repeats.alias("repeats"))


def solve_exponent(shares: DataFrame, budget: float | None, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent by bisection: entropy falls from the uniform weights' at 0 towards that of the largest sources alone.

    With target_entropy, the exponent from 0 to MOST at which the weights have that entropy. With max_repeats, the least
    exponent from 0 to 1 at which no source is repeated more often (beyond 1 the largest source is repeated more and more). A
    target out of reach is a ValueError. Each pass over the sources evaluates the 127 midpoints that LEVELS halvings can
    meet; nothing but their sums is collected.
    """

    def small_enough(row) -> bool:
        """Whether the exponent sought is at this one or below."""
        return row.entropy <= target_entropy + 1e-12 if target_entropy is not None else row.repeats <= max_repeats * (1 + 1e-12)

    steps = [0.0, *(2.0**k for k in range(MOST.bit_length()))] if target_entropy is not None else [0.0, 1.0]
    ends = {r.a: r for r in mixture(shares, budget, steps).collect()}
    if not ends:
        return 0.0
    if target_entropy is not None and target_entropy > ends[0.0].entropy + 1e-9:
        raise ValueError(f"target_entropy {target_entropy} is above {ends[0.0].entropy}, that of equal weights")
    reached = [a for a in steps if small_enough(ends[a])]
    if not reached:
        raise ValueError(f"no exponent meets {'target_entropy' if target_entropy is not None else 'max_repeats'}: at {steps[-1]} the weights give {ends[steps[-1]]}")
    if reached[0] == 0:
        return 0.0
    low, high = steps[steps.index(reached[0]) - 1], reached[0]
    for _ in range(HALVINGS // LEVELS):
        points = [low + (high - low) * i / 2**LEVELS for i in range(1, 2**LEVELS)]
        at = {r.a: r for r in mixture(shares, budget, points).collect()}
        lo, hi = 0, 2**LEVELS
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if small_enough(at[points[mid - 1]]) else (mid, hi)
        points = [low, *points, high]
        low, high = points[lo], points[hi]
    return high


def mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = 1.05,
    budget: int | None = None,
    block_rows: int = 256,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    whole: bool = False,
) -> DataFrame:
    """The mixed stream: a row for each time that a document is used, with its place in its source's stream.

    A document's tokens are its runs of non-blank characters and one for its end. A source's weight is its token share to the
    power of the exponent that meets the target (see solve_exponent), normalised; its budget is that weight of `budget`
    (default: all tokens of the input). A source's documents are dealt into blocks of about block_rows by hash. Each pass
    over a source permutes its blocks and the documents in them anew; full passes use all documents, the last pass ends
    with the document at which the source's budget is reached. A target that no exponent meets is a ValueError; a limit of
    repetitions of 1 or more can be met whenever the budget is the tokens of the input. With whole, the budget is the least
    that uses every document: the source that is raised least is used once, all others as often as their weights ask.

    Result: id, source, n_tokens, weight, repeat (pass, from 0), block, start_token (tokens of the source's stream before it)
    and order_key, start_token as a share of the source's budget: ascending order_key interleaves the sources evenly. The
    documents that a source's budget doesn't reach are left out of the stream, as the mixing asks; with whole there are none.

    Prefix sums run over superblocks, over blocks within a superblock and over documents within a block, about the cube root
    of a source's documents at each level in turn, so a source with a third of all rows is spread over many tasks.

    Rows are numbered by the task that reads them (they may be equal in id and text), so the order of the stream also depends
    on how the table is split into tasks. A null source is a source of its own; null and empty texts have one token; repeated rows are rows of their own. An empty
    table gives an empty stream. Texts are read once and never shuffled; other columns are not carried.
    """
    how = {"target_entropy": target_entropy, "max_repeats": max_repeats, "budget": budget, "block_rows": block_rows, "seed": seed, "whole": whole}
    return _mixed(docs, id_col, source_col, text_col, **how)[0].drop("uid")


def _mixed(docs: DataFrame, id_col: str, source_col: str, text_col: str, target_entropy: float | None, max_repeats: float | None, budget: int | None, block_rows: int, seed: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """The stream of mix() with uid, a number of the input row, and the written table of input rows: uid, id, digest."""
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give target_entropy or max_repeats")
    if whole and budget is not None:
        raise ValueError("whole sets the budget")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), (n_words(F.col(text_col)) + 1).cast("long").alias("n_tokens"), digest(text_col).alias("digest"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "id", "digest"))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "mix-sizes")
    by_source = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = by_source.agg(F.sum("tokens")).first()[0] or 0
    budget = None if whole else budget or total
    most = by_source.agg(F.max("tokens")).first()[0] or 1
    shares = written(by_source.withColumn("relative", F.col("tokens") / F.lit(most)), "mix-sources")
    exponent = solve_exponent(shares, budget, target_entropy, max_repeats)
    raised = F.pow("relative", F.lit(exponent))
    sums = shares.agg(F.sum(raised).alias("z"), F.min(raised / F.col("tokens")).alias("least")).first()
    weight = raised / F.lit(sums.z or 1.0)
    if whole:
        times = F.greatest(raised / F.col("tokens") / F.lit(sums.least or 1.0), F.lit(1.0))
        goal = F.col("tokens") * (times if max_repeats is None else F.least(times, F.lit(float(max_repeats))))
    else:
        goal = weight * F.lit(float(budget))
    plan = shares.select(F.col("source").alias("of"), "tokens", "rows", weight.alias("weight"), goal.alias("goal"))
    plan = plan.withColumn("blocks", F.ceil(F.col("rows") / block_rows)).withColumn("supers", F.ceil(F.sqrt("blocks")))
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of", "rows")
    # identical rows (same id and text, or no id) have the same key: uid tells them apart, so they fall into many blocks
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key", "uid"), F.col("blocks"))).withColumn("super", F.col("block") % F.col("supers")).drop("blocks", "supers")
    last = F.floor(F.col("goal") / F.col("tokens"))
    used = placed.withColumn("repeat", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    order: dict[str, Column] = {c: F.xxhash64(F.lit(seed), "repeat", c) for c in ("super", "block", "key")}
    group = ["source", "repeat"]

    def before(df: DataFrame, by: list[str], what: str, sums: str) -> Column:
        w = Window.partitionBy(*by).orderBy(*([order[what], what] if what != "key" else [order["key"], "key", "uid"]))
        return F.sum(sums).over(w) - F.col(sums)

    block_sums = used.groupBy(*group, "super", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    super_sums = block_sums.groupBy(*group, "super").agg(F.sum("block_tokens").alias("super_tokens"))
    super_sums = super_sums.withColumn("super_before", before(super_sums, group, "super", "super_tokens")).drop("super_tokens")
    block_sums = block_sums.withColumn("block_before", before(block_sums, [*group, "super"], "block", "block_tokens")).drop("block_tokens")
    same = lambda a, b, on: [a[c].eqNullSafe(b[c]) for c in on]
    starts = block_sums.join(super_sums, same(block_sums, super_sums, [*group, "super"])).select(
        *[block_sums[c] for c in (*group, "block")], (F.col("super_before") + F.col("block_before")).alias("before")
    )
    used = used.withColumn("in_block", before(used, [*group, "block"], "key", "n_tokens"))
    out = used.join(starts, same(used, starts, [*group, "block"])).drop(starts["source"]).drop(starts["repeat"]).drop(starts["block"])
    start = F.col("repeat") * F.col("tokens") + F.col("before") + F.col("in_block")
    out = out.withColumn("start_token", start.cast("long")).where(F.col("start_token") < F.col("goal"))
    stream = out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", F.round("weight", 9).alias("weight"), "repeat", "block", "start_token", F.round(F.col("start_token") / F.col("goal"), 9).alias("order_key"), "uid"
    )
    return stream, rows


def digest(text_col: str) -> Column:
    """96 bits of a text, null counted as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.struct(F.xxhash64(text).alias("x"), F.crc32(text.cast("binary")).alias("c"))


def mixed_documents(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = 1.05,
    budget: int | None = None,
    block_rows: int = 256,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    whole: bool = False,
) -> DataFrame:
    """docs with each row as often as the mixed stream uses it (not at all, once, or repeatedly), all columns kept.

    Rows that share id and text divide their uses evenly. They are numbered within the tasks that wrote them and by those
    tasks' counts, so that a text that stands in a third of all rows under one id, or none, is numbered by many tasks. Other
    arguments as in mix().
    """
    stream, own = _mixed(docs, id_col, source_col, text_col, target_entropy, max_repeats, budget, block_rows, seed, whole)
    used = stream.groupBy("uid").agg(F.count(F.lit(1)).alias("uses"))
    groups = own.select("uid", "id", "digest").join(used, "uid", "left").groupBy(F.col("id").alias("of"), F.col("digest").alias("of_digest"))
    groups = written(groups.agg(F.sum(F.coalesce("uses", F.lit(0))).alias("uses"), F.count(F.lit(1)).alias("n")).where("uses > 0"), "mix-uses")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), digest(text_col).alias("digest"))
    rows = rows.join(groups, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest"))).drop("of", "of_digest")
    key, w = ["id", "digest", "task"], Window.partitionBy("id", "digest")
    again = written(rows.where("n > 1").withColumn("task", F.spark_partition_id()), "mix-repeated")
    counts = again.groupBy(*key).count().withColumn("before", F.sum("count").over(w.orderBy("task")) - F.col("count"))
    starts = counts.select(*[F.col(c).alias(f"of_{c}") for c in key], "before")
    placed = again.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("task")))
    placed = placed.join(starts, (F.col("task") == F.col("of_task")) & (F.col("digest") == F.col("of_digest")) & F.col("id").eqNullSafe(F.col("of_id")))
    extra = F.when(F.col("place") + F.col("before") <= F.col("uses") % F.col("n"), 1).otherwise(0)
    alone = rows.where("n = 1").select("row", F.col("uses").alias("k"))
    used = alone.unionByName(placed.select("row", (F.expr("uses div n") + extra).alias("k"))).where("k > 0")
    return used.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("k").cast("int")))).select("row.*")
