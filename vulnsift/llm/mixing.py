"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic); that aggregate is small next to the texts. The cell
weights are raked: scaled so that the shares of every source match their target, then those of every language,
then of every topic, round after round. Every ``ROUNDS_A_PLAN`` rounds the marginals are looked at: raking ends when all are within
``TOLERANCE`` of their targets, or when they no longer come closer (targets that contradict each other), which is logged. Up to ``FEW_CELLS``
cells, counted first, are raked in one partition; more cells by partially aggregated sums that are joined back, so a category with a third of
all rows is one number per task. Both stop by the same rule. No cell table is collected.

Targets may be given as ``{category: share}`` per marginal. Those are kept. Categories without a target (or with target 0) get weight 0;
targets of categories that have no tokens are ignored, the others scaled up. Of a marginal without given targets the target of a
category is its share of tokens to the power ``temper`` (normalised), which lifts the small ones; these targets give way where the tokens don't suffice.

No cell can give more tokens than it has. Without ``keep`` the draw (``bounded``) is ``KEEP`` of all tokens, or what the given targets allow
if that is less. A category without a given target that has too few tokens for its share of that draw is held at all its tokens, and
what is missing is handed to the others of its marginal in proportion to their targets. So a category of one document costs the draw
one document. Should cells still be short, because categories overlap, the tempered targets go back halfway and then wholly to the shares that
follow from the given targets alone (those of the corpus, if none is given), and then the draw becomes smaller.
With a given ``keep`` the amount decides: a chance is ``min(1, c * weight / tokens)`` of its cell, with
``c`` calibrated so that the expected tokens are ``keep`` of all; cells at 1 give their rest to the others, so targets that need more than
these cells have are missed. ``marginals`` gives the target, reachable, expected and drawn shares of either.

A document stays if a hash of its id and the seed, read as a number in [0, 1), is below its cell's chance: the same
documents on every run and every cluster.

The topic is a column of the caller's, or ``topic_of``: the kind of text told by its marks (notices, tables, contacts, prose). Masking
personal data doesn't change it, unless a card, account or secret number runs into an address and swallows it.

Defined cases: null source, language or topic is the category ``""``; a text's tokens are its white-space words, so null and
empty texts have none: they are kept with the chance of their cell, and a cell without tokens keeps none; a very long text counts
whole; equal rows share their fate; null ids hash like other values; an empty table gives no rows; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.llm import pii
from vulnsift.llm.common import cut

log = logging.getLogger(__name__)

MARGINALS = ("source", "lang", "topic")
TOLERANCE = 1e-3
#: raking gives up when ``ROUNDS_A_PLAN`` rounds leave more than this part of the miss before them
STALL = 0.95
KEEP = 0.7
#: draws tried under given targets, from the most that single categories allow (0) to the draw without any bound reached (1)
TRIES = (0.0, 0.05, 0.15, 0.4, 1.0)
#: how much of the tempering is tried for marginals without given targets
TEMPERED = (1.0, 0.5, 0.0)
#: so few cells are raked in one partition, and their chances broadcast; more cells take part in shuffles
FEW_CELLS = 200_000
ROUNDS_A_PLAN = 4
TEMPER = 0.7
SEED = 17


def tokens_of(text: Column) -> Column:
    """White-space words of a text, counted as the places where one begins."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("bigint")


def topic_of(text: Column) -> Column:
    """Told by marks that masking leaves or replaces by its own: words inside an address don't count, its placeholder does."""
    t = F.coalesce(text, F.lit(""))
    pattern = {k.name: k.pattern for k in pii.kinds()}
    words = F.when(t.contains("@"), F.regexp_replace(t, pattern["email"], " ")).otherwise(t)
    contact = (t.contains("@") & t.rlike(pattern["email"])) | (t.contains("+") & t.rlike(pattern["phone"])) \
        | t.contains("[EMAIL]") | t.contains("[PHONE]")
    return F.when(words.rlike("(?i)licen[sc]e|copyright"), "notice").when(t.contains(" | "), "table") \
        .when(contact, "contact").otherwise("prose")


def _keys(docs: DataFrame, topic: Column) -> list[Column]:
    given = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    return [F.coalesce(given[m].cast("string"), F.lit("")).alias(m) for m in MARGINALS]


def cells(docs: DataFrame, topic: Column | None = None, text: str = "text") -> DataFrame:
    """``source, lang, topic, tokens, docs`` of the corpus."""
    topic = topic_of(F.col(text)) if topic is None else topic
    return docs.select(*_keys(docs, topic), tokens_of(F.col(text)).alias("tokens")).groupBy(*MARGINALS) \
        .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def _sums(cells: DataFrame, m: str, few: bool, **values: Column) -> DataFrame:
    """Add sums over the cells of the same category. Few cells lie in one partition, where a window
    needs no shuffle; many are summed by a partial aggregate that is joined back."""
    if few:
        return cells.withColumns({out: F.sum(v).over(Window.partitionBy(m)) for out, v in values.items()})
    return cells.join(cells.groupBy(m).agg(*[F.sum(v).alias(out) for out, v in values.items()]), m)


def _stored(cells: DataFrame, few: bool) -> DataFrame:
    return cut(cells.coalesce(1)).coalesce(1) if few else cut(cells)


def _goal(m: str, given: dict[str, float] | None, temper: float) -> Column:
    """The target of a category with ``t`` tokens, not yet normalised."""
    goal = F.pow("t", F.lit(temper)) if given is None else F.coalesce(F.try_element_at(F.create_map(
        *[F.lit(x) for k, v in given.items() for x in (str(k), float(v))]), F.col(m)), F.lit(0.0))
    return F.when(F.col("t") > 0, goal).otherwise(0.0)


def _rounds(now: DataFrame, few: bool, one: Callable[[DataFrame], DataFrame], miss: Callable[[DataFrame], Column | None],
            tolerance: float) -> tuple[DataFrame, float]:
    """The cells after as many rounds as it takes, and the largest relative miss of a marginal."""
    last = float("inf")
    while True:
        for _ in range(ROUNDS_A_PLAN):
            now = one(now) if few else _stored(one(now), few)
        now = _stored(now, few) if few else now
        off = miss(now) or 0.0
        if off < tolerance or off > STALL * last:
            return now, off
        last = off


def rake(table: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER,
         tolerance: float = TOLERANCE, over: tuple[str, ...] = MARGINALS) -> DataFrame:
    """The cells with a ``weight``: tokens raked over the marginals ``over``, in tokens of the corpus."""
    targets = targets or {}
    if not over:
        return table.select(*MARGINALS, "tokens", "docs", F.col("tokens").cast("double").alias("weight"))
    few = table.count() <= FEW_CELLS
    now = table.coalesce(1) if few else table
    for m in over:
        now = _sums(now, m, few, **{"t": F.col("tokens"), f"n_{m}": F.lit(1)})
        now = now.withColumn(f"goal_{m}", _goal(m, targets.get(m), temper)).drop("t")
    now = _stored(now.withColumn("weight", F.col("tokens").cast("double")), few)
    sums = now.agg(F.sum("tokens").alias("tokens"), *[F.sum(F.col(f"goal_{m}") / F.col(f"n_{m}")).alias(m) for m in over]).first()
    total = float(sums.tokens or 0)

    def one(now: DataFrame) -> DataFrame:
        now = now.withColumn("off", F.lit(0.0))
        for m in over:
            now = _sums(now, m, few, have=F.col("weight"))
            factor = F.when(F.col("have") > 0, F.col(f"goal_{m}") * (total / (sums[m] or 1.0)) / F.col("have")).otherwise(0.0)
            now = now.withColumn("factor", factor)
            # how far the marginal was off, over cells that count
            off = F.when(F.col("weight") * F.col("factor") > 0, F.abs(F.col("factor") - 1)).otherwise(0.0)
            now = now.withColumn("off", F.greatest("off", off)).withColumn("weight", F.col("weight") * F.col("factor")) \
                .drop("have", "factor")
        return now

    now, off = _rounds(now, few, one, lambda cells: cells.agg(F.max("off")).first()[0], tolerance)
    if off >= tolerance:
        log.warning("raking came no closer than %.2g to its targets", off)
    return now.select(*MARGINALS, "tokens", "docs", "weight")


def chances(weighted: DataFrame, keep: float = KEEP) -> DataFrame:
    """The cells with ``chance``: the calibrated probability that a document of the cell stays."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    r = cut(weighted.select(*MARGINALS, "tokens", ratio.alias("ratio")))
    want = keep * float(r.agg(F.sum("tokens")).first()[0] or 0)
    c = 0.0
    for _ in range(60):                         # cells that reach 1 hand on what is left of the budget
        sums = r.agg(F.sum(F.when(F.col("ratio") * c >= 1, F.col("tokens"))).alias("full"),
                     F.sum(F.when(F.col("ratio") * c < 1, F.col("tokens") * F.col("ratio"))).alias("rest")).first()
        nxt = (want - float(sums.full or 0)) / float(sums.rest) if sums.rest else c
        if nxt <= c * (1 + 1e-12):
            break
        c = nxt
    return r.select(*MARGINALS, F.least(F.lit(1.0), F.col("ratio") * c).alias("chance"))


def bounded(table: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, keep: float = KEEP,
            tolerance: float = TOLERANCE) -> DataFrame:
    """The cells with ``chance`` and the tokens ``goal_source, goal_lang, goal_topic`` that their categories are to give.

    A category's factor is a Newton step towards its goal (its cells at their bound count as they are) from below, the
    plain ratio from above: the fixed points are the weights whose bounded marginals meet the goals. Cells of a category that is to
    give all its tokens are full from the start. The last try, at which no cell reaches its bound, needs no round."""
    targets = targets or {}
    fixed = tuple(m for m in MARGINALS if m in targets)
    loose = tuple(m for m in MARGINALS if m not in targets)
    now = rake(table, targets, temper, tolerance, fixed)
    few = now.count() <= FEW_CELLS
    now = now.select(*MARGINALS, F.col("tokens").cast("double").alias("tokens"), F.col("weight").alias("base"))
    now = now.coalesce(1) if few else now
    used = F.col("base") > 0
    for m in MARGINALS:
        now = _sums(now, m, few, **{f"base_{m}": F.col("base"), f"n_{m}": F.when(used, 1),
                                    f"t_{m}": F.when(used, F.col("tokens")).otherwise(0.0)})
    now = _stored(now, few)
    facts = now.agg(F.sum("tokens").alias("tokens"), F.sum("base").alias("base"), F.sum(F.when(used, F.col("tokens"))).alias("usable"),
                    F.min(F.when(used, F.col("tokens") / F.col("base"))).alias("free"),
                    *[F.sum(F.when(used, F.pow(f"t_{m}", F.lit(temper)) / F.col(f"n_{m}"))).alias(f"temper_{m}") for m in loose],
                    *[F.min(F.when(used, F.col(f"t_{m}") / F.col(f"base_{m}"))).alias(f"most_{m}") for m in fixed]).first()
    if not facts.base:
        return now.select(*MARGINALS, F.lit(0.0).alias("chance"), *[F.lit(0.0).alias(f"goal_{m}") for m in MARGINALS])
    most = min(keep * facts.tokens, facts.usable, *[facts[f"most_{m}"] * facts.base for m in fixed])
    free = min(most, facts.free * facts.base)
    draws = [most * (free / most) ** part for part in TRIES] if 0 < free < most else [most]
    tries = [(draw, part) for draw in draws for part in (TEMPERED if loose else (0.0,))]
    for draw, part in tries:
        goals = _reachable(now, fixed, loose, draw, part, facts, temper)
        cells = now.withColumns({f"goal_{m}": F.when(used, g).otherwise(0.0) for m, g in goals.items()}) \
            .withColumn("weight", F.col("base") * (draw / facts.base))
        if (draw, part) == tries[-1]:
            break
        whole = [F.col(f"goal_{m}") >= F.col(f"t_{m}") * (1 - 1e-9) for m in MARGINALS]
        cells = cells.withColumn("pinned", used & (whole[0] | whole[1] | whole[2]))
        cells = _stored(cells.withColumn("weight", F.when(F.col("pinned"), F.col("tokens")).otherwise(F.col("weight"))), few)
        done, off = _rounds(cells, few, lambda c: _bounded_round(c, few), lambda c: _bounded_miss(c, few), tolerance)
        if off < tolerance:
            cells = done
            break
        log.warning("a draw of %.3g tokens at %.0f %% of the tempering misses its targets by %.2g", draw, 100 * part, off)
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("tokens"))).otherwise(0.0)
    return cells.select(*MARGINALS, chance.alias("chance"), *[f"goal_{m}" for m in MARGINALS])


def _reachable(cells: DataFrame, fixed: tuple[str, ...], loose: tuple[str, ...], draw: float, part: float, facts,
               temper: float) -> dict[str, Column]:
    """The tokens that a category is to give, by marginal. The missing tokens of categories that give all they have are
    handed on until no further one is short; each pass is one aggregate of all loose marginals."""
    out = {m: F.col(f"base_{m}") * (draw / facts.base) for m in fixed}
    raw = {m: F.col(f"base_{m}") * ((1 - part) / facts.base) + F.pow(f"t_{m}", F.lit(temper)) * (part / facts[f"temper_{m}"])
           for m in loose}
    scale = dict.fromkeys(loose, draw)
    while loose:
        short = {m: raw[m] * scale[m] >= F.col(f"t_{m}") for m in loose}
        sums = cells.where("base > 0").agg(
            *[F.sum(F.when(short[m], F.col(f"t_{m}") / F.col(f"n_{m}")).otherwise(0.0)).alias(f"full_{m}") for m in loose],
            *[F.sum(F.when(short[m], 0.0).otherwise(raw[m] / F.col(f"n_{m}"))).alias(f"rest_{m}") for m in loose]).first()
        new = {m: (draw - sums[f"full_{m}"]) / sums[f"rest_{m}"] if sums[f"rest_{m}"] else scale[m] for m in loose}
        if all(new[m] <= scale[m] * (1 + 1e-12) for m in loose):
            break
        scale = {m: max(new[m], scale[m]) for m in loose}
    return out | {m: F.least(F.col(f"t_{m}"), raw[m] * scale[m]) for m in loose}


def _bounded_sums(now: DataFrame, m: str, few: bool) -> DataFrame:
    """Add ``pin``, ``full`` and ``rest``: tokens of a category's pinned cells and of the others at their bound, weights of all others."""
    at, pin = F.col("weight") >= F.col("tokens"), F.col("pinned")
    return _sums(now, m, few, pin=F.when(pin, F.col("tokens")).otherwise(0.0),
                 full=F.when(at & ~pin, F.col("tokens")).otherwise(0.0), rest=F.when(at | pin, 0.0).otherwise(F.col("weight")))


def _bounded_round(now: DataFrame, few: bool) -> DataFrame:
    for m in MARGINALS:
        now = _bounded_sums(now, m, few)
        have, goal = F.col("full") + F.col("rest"), F.greatest(F.col(f"goal_{m}") - F.col("pin"), F.lit(0.0))
        factor = F.when(have <= 0, 0.0).when(have >= goal, goal / have) \
            .when(F.col("rest") > 0, (goal - F.col("full")) / F.col("rest")).otherwise(1.0)
        # far above its bound a weight would take as many rounds to come back
        now = now.withColumn("weight", F.when(F.col("pinned"), F.col("weight")).otherwise(
            F.least(F.col("weight") * factor, F.col("tokens") * 1e3))).drop("pin", "full", "rest")
    return now


def _bounded_miss(now: DataFrame, few: bool) -> float | None:
    off = []
    for m in MARGINALS:
        now = _bounded_sums(now, m, few).withColumn(f"off_{m}", F.when(F.col(f"goal_{m}") > 0, F.abs(
            (F.col("pin") + F.col("full") + F.col("rest")) / F.col(f"goal_{m}") - 1)).otherwise(0.0)).drop("pin", "full", "rest")
        off.append(F.col(f"off_{m}"))
    return now.agg(F.max(F.greatest(*off))).first()[0]


def uniform(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """A number in [0, 1) from the id and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) / F.lit(float(1 << 53))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float | None = None, temper: float = TEMPER,
           seed: int = SEED, topic: Column | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The sampled rows of ``docs`` with all their columns."""
    chance = _chances_for(docs, targets, keep, temper, topic, text)
    return _drawn(docs, chance, seed, topic, text, id_col).where("_mix_u < _mix_chance").select(*[F.col(f"`{c}`") for c in docs.columns])


def _chances_for(docs, targets, keep, temper, topic, text) -> DataFrame:
    table = cut(cells(docs, topic, text))
    return cut(bounded(table, targets, temper) if keep is None else chances(rake(table, targets, temper), keep))


def _drawn(docs, chance, seed, topic, text, id_col) -> DataFrame:
    topic = topic_of(F.col(text)) if topic is None else topic
    keyed = docs
    for m, key in zip(MARGINALS, _keys(docs, topic)):
        keyed = keyed.withColumn(f"_mix_{m}", key)
    table = chance.select(*[F.col(m).alias(f"_mix_{m}") for m in MARGINALS], F.col("chance").alias("_mix_chance"))
    if chance.count() <= FEW_CELLS:
        table = F.broadcast(table)
    return keyed.join(table, [f"_mix_{m}" for m in MARGINALS], "left") \
        .withColumn("_mix_u", uniform(id_col, seed))


def report(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float | None = None, temper: float = TEMPER,
           seed: int = SEED, topic: Column | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, cell, chance and verdict of every document."""
    drawn = _drawn(docs.select(F.col(id_col).alias("doc_id"), "source", "lang", F.col(text).alias("text")),
                   _chances_for(docs, targets, keep, temper, topic, text), seed, topic, "text", "doc_id")
    return drawn.select("doc_id", F.col("_mix_source").alias("source"), F.col("_mix_lang").alias("lang"),
                        F.col("_mix_topic").alias("topic"), F.coalesce("_mix_chance", F.lit(0.0)).alias("chance"),
                        (F.col("_mix_u") < F.coalesce("_mix_chance", F.lit(0.0))).alias("kept"))


def marginals(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float | None = None, temper: float = TEMPER,
              seed: int = SEED, topic: Column | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``marginal, category`` and shares of tokens: ``corpus``, ``target``, ``reachable`` (the target where all have tokens enough for the
    draw), ``expected`` of the draw, ``drawn``."""
    table = _chances_for(docs, targets, keep, temper, topic, text)
    drawn = _drawn(docs, table, seed, topic, text, id_col)
    n, chance = tokens_of(F.col(text)), F.coalesce("_mix_chance", F.lit(0.0))
    by_cell = cut(drawn.groupBy(*[F.col(f"_mix_{m}").alias(m) for m in MARGINALS]).agg(
        F.sum(n).alias("t"), F.sum(n * chance).alias("e"), F.sum(F.when(F.col("_mix_u") < chance, n).otherwise(0)).alias("d")))
    out = None
    for m in MARGINALS:
        own = by_cell.groupBy(m).agg(*[F.sum(c).alias(c) for c in "ted"]).withColumn("g", _goal(m, (targets or {}).get(m), temper))
        own = own.withColumn("r", F.col("g")) if keep is not None else \
            own.join(table.groupBy(m).agg(F.max(f"goal_{m}").alias("r")), m, "left")
        total = own.agg(*[F.sum(c).alias(f"all_{c}") for c in "tgred"])
        part = own.crossJoin(F.broadcast(total)).select(F.lit(m).alias("marginal"), F.col(m).alias("category"), *[
            F.when(F.col(f"all_{c}") > 0, F.col(c) / F.col(f"all_{c}")).otherwise(0.0).alias(name)
            for c, name in zip("tgred", ("corpus", "target", "reachable", "expected", "drawn"))])
        out = part if out is None else out.unionByName(part)
    return out
