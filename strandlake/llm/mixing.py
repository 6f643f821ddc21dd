"""Temperature mixing of sources. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.common import stored

GRID = 1024  # the exponent is a multiple of 1 / GRID in [0, 1]
CUTS = 32  # parts of a range of exponents that are told apart at once
BLOCK_TOKENS = 100_000
MAX_REPEAT = 4.0
TARGET_ENTROPY = 0.9  # of the largest possible, log(number of sources)
DIGITS = 3  # of a block's order key: its blocks are added up in 16 ** DIGITS groups first


def token_count(text: Column) -> Column:
    """Words: maximal runs of characters other than space, tab to carriage return."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return (F.char_length(squeezed) - F.char_length(F.translate(squeezed, "w", ""))).cast("long")


def _shares(sources: DataFrame, exponents: list[int]) -> DataFrame:
    """One row per exponent: the mixture's entropy, the largest possible, and the most any source repeats."""
    alphas = F.explode(F.array(*[F.lit(k) for k in exponents]))
    raised = sources.select(alphas.alias("k"), "_tokens").select(
        "k", "_tokens", F.pow(F.col("_tokens").cast("double"), F.col("k") / GRID).alias("u")
    )
    return raised.groupBy("k").agg(
        # H = log Z - sum(u log u) / Z for weights u / Z
        (F.log(F.sum("u")) - F.sum(F.col("u") * F.log("u")) / F.sum("u")).alias("h"),
        F.log(F.count(F.lit(1)).cast("double")).alias("h_max"),
        (F.max(F.col("u") / F.col("_tokens")) * F.sum("_tokens") / F.sum("u")).alias("repeat"),
        (F.max(F.col("u") / F.col("_tokens")) * F.max(F.col("_tokens") / F.col("u"))).alias("repeat_whole"),
    )


def solve_exponent(sources: DataFrame, target_entropy: float, max_repeat: float, whole: bool = False) -> int:
    """Smallest k, exponent k / GRID, whose mixture repeats no source beyond ``max_repeat``,
    or the largest k that reaches ``target_entropy``, whichever is larger.

    Entropy and the largest repetition both fall as the exponent rises to 1,
    so each bound is bisected, five halvings at a time: one aggregation over
    the sources tests the CUTS - 1 exponents at which they may look, for both
    bounds, and one row an exponent comes to the driver.
    """
    seen: dict[int, tuple[bool, bool]] = {}

    def look(*ranges: tuple[int, int]) -> None:
        ks = {GRID} | {lo + (hi - lo) * i // CUTS for lo, hi in ranges for i in range(CUTS)}
        rows = _shares(sources, sorted(ks - set(seen))).collect() if ks - set(seen) else []
        for r in rows:
            seen[r["k"]] = (r["h"] >= target_entropy * r["h_max"] - 1e-9, r["repeat_whole" if whole else "repeat"] <= max_repeat + 1e-9)
        for k in ks - set(seen):  # no sources
            seen[k] = (True, True)

    def between(holds) -> tuple[int, int]:
        """The largest exponent seen at which ``holds`` is false (-1: none), and the smallest at which it is true, GRID by assumption."""
        return max((k for k in seen if not holds(k)), default=-1), min((k for k in seen if holds(k)), default=GRID)

    low_entropy, few_repeats = (lambda k: not seen[k][0]), (lambda k: seen[k][1])
    look((0, GRID))
    while any(hi - lo > 1 for lo, hi in (between(low_entropy), between(few_repeats))):
        look(between(low_entropy), between(few_repeats))
    for_entropy = between(low_entropy)[1] - 1 if not seen[GRID][0] else GRID
    return max(for_entropy, between(few_repeats)[1], 0)


def _order(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _block(key: Column) -> Column:
    """A document's block among its source's ``_blocks``."""
    return F.pmod(F.conv(F.substring(_order(key), 1, 12), 16, 10).cast("long"), F.col("_blocks"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float = TARGET_ENTROPY,
    max_repeat: float = MAX_REPEAT,
    whole: bool = False,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """A schedule of documents whose source shares meet the solved weights.

    Shares of tokens are raised to an exponent (see :func:`solve_exponent`)
    and normalised. The budget is the corpus' own tokens (``whole=False``), or
    the smallest budget under which every source is read at least once
    (``whole=True``, nothing is dropped). A source's budget is spent in epochs:
    in each, its blocks (of about ``block_tokens``) stand in a permuted order
    and so do the documents within a block; whole epochs come first and the
    last one stops at the document with which the budget is reached.

    Only block totals are added up per source, by the first DIGITS digits of
    the blocks' order keys and then within them, so a source with a third of
    all rows is spread over its blocks, and its blocks over groups.

    Returns ``id_col, source, epoch (from 0), block, n_tokens, start`` -- one
    row per scheduled reading; start counts the source's tokens before it.
    Null text has no tokens; documents without tokens are read once, in epoch
    0, if their block is; null sources form a source of their own, shown as
    null; rows repeated under one id are all scheduled. Empty in, empty out.
    """
    out, _ = _schedule(docs, id_col, text_col, source_col, target_entropy, max_repeat, whole, block_tokens)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias("source"),
        F.col("_epoch").alias("epoch"),
        F.col("_block").alias("block"),
        F.col("_n").alias("n_tokens"),
        F.col("_start").alias("start"),
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float = TARGET_ENTROPY,
    max_repeat: float = MAX_REPEAT,
    whole: bool = False,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The documents of :func:`mix`'s schedule, as often as it reads them; columns, of any name, unchanged.

    In each epoch a block's documents are read up to one place of its permuted
    order, so the schedule comes back as one place per block and epoch, and
    texts are repeated where they are read, not shuffled to their schedule.
    """
    out, plan = _schedule(docs, id_col, text_col, source_col, target_entropy, max_repeat, whole, block_tokens)
    place = F.struct(F.col("_dkey").alias("k"), F.col("_id").alias("i"))
    ends = out.groupBy("_source", "_block", "_epoch").agg(F.max(F.when(F.col("_n") > 0, place)).alias("last"))
    ends = ends.groupBy("_source", "_block").agg(F.collect_list(F.struct("_epoch", "last")).alias("_ends"))
    ends = stored(ends.select(F.col("_source").alias("_es"), F.col("_block").alias("_eb"), "_ends"), "mix-ends")
    row = F.col("row")  # all of a document's columns, so that none clashes
    key, source = row.getField(id_col), row.getField(source_col).cast("string")
    worded = F.coalesce(row.getField(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    read = lambda e: F.struct(_order(key, e["_epoch"]).alias("k"), key.alias("i")) <= e["last"]
    times = F.when(worded, F.size(F.filter("_ends", read))).otherwise(F.size(F.filter("_ends", lambda e: e["_epoch"] == 0)))
    found = docs.select(F.struct("*").alias("row")).join(plan.select("_s", "_blocks"), source.eqNullSafe(F.col("_s"))).withColumn("_b0", _block(key))
    found = found.join(ends, F.col("_s").eqNullSafe(F.col("_es")) & (F.col("_b0") == F.col("_eb"))).withColumn("_times", times)
    return found.where("_times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")


def _schedule(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, target_entropy: float, max_repeat: float, whole: bool, block_tokens: int
) -> tuple[DataFrame, DataFrame]:
    """Scheduled readings with their order key, and the plan of each source."""
    rows = stored(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).cast("string").alias("_source"),
            token_count(F.col(text_col)).alias("_n"),
        ),
        "mix-rows",
    )
    totals = stored(rows.groupBy("_source").agg(F.sum("_n").alias("_tokens")), "mix-sources")
    live = totals.where(F.col("_tokens") > 0)
    k = solve_exponent(live, target_entropy, max_repeat, whole)
    alpha = k / GRID
    u = F.pow(F.col("_tokens").cast("double"), F.lit(alpha))
    z = live.agg(F.sum(u).alias("z"), F.sum("_tokens").alias("t"), F.max(F.col("_tokens") / u).alias("most")).first()
    scale = (z["most"] if whole else z["t"] / z["z"]) if z["z"] else 0.0
    quota = F.when(F.col("_tokens") > 0, F.greatest(F.floor(u * F.lit(scale) + 1e-6), F.lit(0))).otherwise(0).cast("long")
    plan = stored(
        totals.select(
            F.col("_source").alias("_s"),
            "_tokens",
            quota.alias("_quota"),
            F.greatest(F.ceil(F.col("_tokens") / block_tokens), F.lit(1)).cast("long").alias("_blocks"),
        ),
        "mix-plan",
    )
    dealt = rows.join(plan, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_block", _block(F.col("_id")))
    blocks = dealt.groupBy("_source", "_block").agg(
        F.sum("_n").alias("_bn"), F.max("_tokens").alias("_tokens"), F.max("_quota").alias("_quota")
    )
    last = F.when(F.col("_tokens") > 0, F.greatest(F.floor((F.col("_quota") - 1) / F.col("_tokens")), F.lit(0))).otherwise(0)
    epochs = blocks.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    # tokens before a block: those of the groups of blocks before its own, and of the blocks before it in its group
    zero = F.lit(0).cast("long")
    before = lambda by, *at: Window.partitionBy(*by).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    keyed = epochs.withColumn("_bkey", _order(F.col("_block"), F.col("_epoch"), F.lit("block"))).withColumn("_g", F.substring("_bkey", 1, DIGITS))
    groups = keyed.groupBy("_source", "_epoch", "_g").agg(F.sum("_bn").alias("_gn"))
    groups = groups.select(F.col("_source").alias("_gs"), F.col("_epoch").alias("_ge"), F.col("_g").alias("_gg"), F.coalesce(F.sum("_gn").over(before(["_source", "_epoch"], "_g")), zero).alias("_base"))
    mine = F.col("_source").eqNullSafe(F.col("_gs")) & (F.col("_epoch") == F.col("_ge")) & (F.col("_g") == F.col("_gg"))
    own = F.coalesce(F.sum("_bn").over(before(["_source", "_epoch", "_g"], "_bkey", "_block")), zero)
    placed = (
        keyed.withColumn("_own", own)
        .join(groups, mine)
        .withColumn("_at", F.col("_epoch") * F.col("_tokens") + F.col("_base") + F.col("_own"))
        .where((F.col("_at") < F.col("_quota")) | ((F.col("_epoch") == 0) & (F.col("_quota") >= F.col("_tokens"))))
        .select(F.col("_source").alias("_s2"), F.col("_block").alias("_b2"), "_epoch", "_at")
    )
    placed = stored(placed, "mix-blocks")
    within = Window.partitionBy("_source", "_block", "_epoch").orderBy("_dkey", "_id").rowsBetween(Window.unboundedPreceding, -1)
    out = (
        dealt.select("_id", "_source", "_n", "_tokens", "_quota", "_block")
        .join(placed, F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_block") == F.col("_b2")))
        .where((F.col("_n") > 0) | (F.col("_epoch") == 0))
        .withColumn("_dkey", _order(F.col("_id"), F.col("_epoch")))
        .withColumn("_start", F.col("_at") + F.coalesce(F.sum("_n").over(within), F.lit(0).cast("long")))
        .where((F.col("_start") < F.col("_quota")) | (F.col("_n") == 0))
    )
    return out, plan
